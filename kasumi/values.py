"""Fixed values that results depend on: categories, confidence levels, labels, characters and patterns."""

from __future__ import annotations

PERSON, COMPANY, TRADEMARK, CONTACT, PLACE, OTHER = "人名", "社名", "商標", "連絡先", "地名", "その他"
#: Fixed: categories, the most important first.
CATEGORIES = [PERSON, COMPANY, TRADEMARK, CONTACT, PLACE, OTHER]
#: Fixed: confidence levels and their rank.
CONFIDENCE = {"確定": 4, "強": 3, "中": 2, "弱": 1, "微弱": 0, "除外": -1}
SURE, STRONG, MEDIUM, WEAK, FAINT, EXCLUDED = CONFIDENCE
#: Fixed: levels that are masked without review, and those a review shows first.
AUTO = (SURE, STRONG)
SHOWN = (SURE, STRONG, MEDIUM, WEAK)
#: Fixed: what a placeholder's number stands after.
PREFIXES = {PERSON: "人物", COMPANY: "社", TRADEMARK: "商標", PLACE: "地名", CONTACT: "連絡先", OTHER: "語"}
UNNAMED_PREFIX, UNNAMED_MASK = "語", "[マスク]"
#: Fixed: labels of entity recognisers (upper case) that count, by category.
NER_LABELS = {
    "PERSON": PERSON,
    "COMPANY": COMPANY,
    "COMPANY_GROUP": COMPANY,
    "CITY": PLACE,
    "PROVINCE": PLACE,
    "COUNTRY": PLACE,
    "ADDRESS": PLACE,
    "POSTAL_ADDRESS": PLACE,
    "FACILITY_PART": PLACE,
    "STATION": PLACE,
    "AIRPORT": PLACE,
}
#: Fixed: types of the language-model detector (case matters), by category.
LLM_TYPES = {
    "Person": PERSON,
    "Company": COMPANY,
    "Department": COMPANY,
    "Province": PLACE,
    "City": PLACE,
    "Country": PLACE,
    "Address": PLACE,
    "Facility": PLACE,
    "Email": CONTACT,
    "Phone_Number": CONTACT,
    "Trademark": TRADEMARK,
    "Employee_ID": OTHER,
    "Account": OTHER,
    "IP_Address": OTHER,
}
#: Fixed: types that stay in review even if they look like code.
LLM_IDENTIFIERS = ("Employee_ID", "Account", "IP_Address")
#: Fixed: part-of-speech prefixes that vote.
POS_PREFIXES = {"名詞-固有名詞-人名": PERSON, "名詞-固有名詞-地名": PLACE, "名詞-固有名詞-一般": OTHER}
#: Fixed: channels that don't count as an opinion of either system.
DICT, SESSION, REGEX, LLM, POS, COLLECTED = "dict", "session", "regex", "llm", "sudachi", "collected"
DECISIVE = (DICT, SESSION, REGEX)
#: Fixed: suffixes of vote labels.
DICT_SUFFIX, EMBED_SUFFIX, SESSION_SUFFIX = "(辞書)", "(辞書·内包)", "(確認済)"
#: Fixed: most tokens of a term.
MAX_TOKENS = 12
#: Fixed: an e-mail address in running text.
EMAIL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{}~-]+@(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
#: Fixed: what makes a surface look like code.
CODE_MARK = r"[_@~\[\]{}=!<>;|\\]|::"
NAME_CHARACTER = "[A-Za-z぀-ヿ㐀-鿿]"
KANJI = "[㐀-鿿]"
CJK_SEPARATORS = "・･「」『』（）〔〕【】〈〉《》｢｣"
DASHES = "-‐‑–—―・･"
JAPANESE_LETTER = "[ぁ-ゖァ-ヺー㐀-䶿一-鿿]"
#: Fixed: characters that keep a surface from being promoted.
SEPARATORS = "・･/／,，、　 \t×"
#: Fixed: characters at which a recogniser's span is cut.
SPAN_CUTS = "、。\n"
#: Fixed: brackets that get a space on their outside.
OPENING, CLOSING = "([{（［｛〔【", ")]}）］｝〕】"
#: Fixed: what joins cells and ends a row, and what joins chunks.
CELL_JOINER, ROW_END, CHUNK_JOINER = "、", "。", "\n\n"
#: Fixed: sub-words of identifiers.
SUBWORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Fixed: sections of the dictionary file, in the order they are written, and an alias.
SECTIONS, SECTION_ALIAS, ALLOW_SECTION = (COMPANY, TRADEMARK, PERSON), {"社員名": PERSON}, "除外"
#: Fixed: chunk size and overlap by type of file.
CHUNKING = {
    "txt": (1000, 100),
    "md": (800, 0),
    "pdf": (1000, 100),
    "docx": (900, 50),
    "doc": (900, 50),
    "xlsx": (1000, 0),
    "xls": (1000, 0),
    "xlsm": (1000, 0),
    "pptx": (800, 50),
    "ppt": (800, 50),
    "html": (1000, 100),
    "xml": (1000, 100),
    "default": (1000, 100),
}
#: Fixed: most bytes of a piece, most tokens of a window and their overlap, characters of a recogniser's batch.
PIECE_BYTES, WINDOW_TOKENS, WINDOW_OVERLAP, BATCH_CHARS = 40_000, 15_000, 0, 20_000
#: Fixed: characters of context beside a span.
CONTEXT = 20
#: Fixed: colours of marked text by family of labels (upper case), and of all other labels.
COLOUR_FAMILIES = {
    "#ff8fab": ("PERSON", PERSON),
    "#ffab5e": ("COMPANY", "COMPANY_GROUP", "CORPORATION_OTHER", "SHOW_ORGANIZATION", "INTERNATIONAL_ORGANIZATION", "POLITICAL_ORGANIZATION_OTHER", "GOVERNMENT", "POLITICAL_PARTY", "SPORTS_ORGANIZATION_OTHER", COMPANY),
    "#c792ea": ("PRODUCT_OTHER", "AWARD", "DECORATION", "OFFENSE", "SERVICE", "CLASS", TRADEMARK),
    "#4fc3b0": ("CITY", "PROVINCE", "COUNTRY", "GPE_OTHER", "ADDRESS", "POSTAL_ADDRESS", "GEOLOGICAL_REGION_OTHER", "LOCATION_OTHER", "DOMESTIC_REGION_OTHER", "CONTINENTAL_REGION_OTHER", "FACILITY_OTHER", "FACILITY_PART", "STATION", "AIRPORT", PLACE),
    "#6cb6ff": ("PHONE_NUMBER", "EMAIL", "URL", CONTACT),
}
PLAIN_COLOUR = "#dcdcdc"
COLOURS = {label: colour for colour, labels in COLOUR_FAMILIES.items() for label in labels}
