"""The registered query of embedded terms against plain Python, over whole texts."""

from itertools import groupby

from kasumi.plans import registry


def compounds(text):
    """Every word followed by Foo and the next word; what parts them stays."""
    parts = ["".join(g) for _, g in groupby(text, key=lambda c: c.isascii() and c.isalpha())]
    word = lambda p: p[0].isascii() and p[0].isalpha()
    return "".join(p + "Foo" + parts[k + 2] if word(p) and k + 2 < len(parts) else p for k, p in enumerate(parts))


def subwords(text):
    """(start, end) of runs of small letters with the capital before them, in tokens of ASCII letters only."""
    found, k = [], 0
    while k < len(text):
        begin, k = k, k + 1
        while k < len(text) and text[k].islower():
            k += 1
        found.append((begin, k))
    return found


def test_hits_after_the_first_words(spark, tmp_path):
    texts = ["One two three Four five", "a th Bar! Th Foo the Bar", "Plain words here, and at the very end th Foo", "single", ""]
    rows = [*enumerate(texts), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = {"foo": "Foo", "bar": "Foo", "th": "th"}
    expected, at = set(), 0
    for doc, text in enumerate(texts):
        made, at = compounds(text), 0
        for is_word, group in groupby(made, key=lambda c: c.isalpha()):
            token = "".join(group)
            subs = subwords(token) if is_word else []
            if len(subs) > 1:
                expected |= {(doc, at + a, at + b, terms[token[a:b].lower()]) for a, b in subs if token[a:b].lower() in terms}
            at += len(token)
    assert any(start > 60 for _, start, _, _ in expected) and {d for d, *_ in expected} == {0, 1, 2}
    got = [(r.doc_id, r.start, r.end, r.canonical) for r in registry.QUERIES["embedded_matches"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
