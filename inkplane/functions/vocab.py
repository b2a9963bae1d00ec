"""Word lists, patterns and constants that results depend on."""

# Word lists, patterns and constants that must equal those of other implementations.
ACCOUNT_NAME_LABELS = ("a/c name", "account name", "nama rekening", "nama fund", "fund name")
BANK_LABELS = ("bank",)
ACCOUNT_NUMBER_LABELS = ("a/c no", "account no", "account number", "no rekening", "nomor rekening")
DEBIT_SECTION_LABELS = ("debit dari", "debit rekening", "debit", "from the following account", "please transfer from the following account")
CREDIT_SECTION_LABELS = ("kredit ke", "kredit rekening", "kredit", "credit", "to the following account")
ADDRESSEE_LABELS = ("kepada", "to", "attn", "up")
PROSE_MARKERS = ("a/n", "atas nama")
FIELD_ROLES = ("debit_account_name", "credit_account_name", "counterparty_org", "bank_name", "signatory_person")
ENTITY_TYPES = ("ORGANIZATION", "PERSON", "CUSTOM", "KNOWN_TERM", "KNOWN_TERM_FUZZY", "BRAND_FOOTER", "BRAND_IMAGE", "SIGNATURE")
SERIF_HINTS = ("times", "georgia", "garamond", "serif", "cambria", "palatino", "minion", "book antiqua", "century", "cardo")
PLACEHOLDER = r"^Client-0{5,}[0-9]+$"
SIGNATURE_CLOSERS = ("hormat kami", "authorized by", "acknowledged by", "yours sincerely", "demikian")
JOB_TITLE_WORDS = ("head", "manager", "division", "department", "director", "officer", "operations", "authorized", "acknowledged", "sincerely")
ORG_PREFIXES = ("pt", "pt.", "cv", "bank", "insurance", "life", "custody", "corp", "ltd", "inc", "asuransi")
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "januari", "februari", "maret", "mei", "juni", "juli", "agustus", "oktober", "desember",
)
GENERIC_ORG_TOKENS = (
    "bank", "custody", "custodian", "kustodian", "ltd", "limited", "corp", "corporation", "incorporated", "inc", "company", "co",
    "group", "holding", "holdings", "wholesale", "banking", "services",
)
DENY_PATTERNS = (
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("US_SSN_RAW", r"\b\d{9}\b"),
    ("NRIC", r"\b[STFGM]\d{7}[A-Z]\b"),
    ("MYKAD", r"\b\d{6}-\d{2}-\d{4}\b"),
    ("HKID", r"\b[A-Z]{1,2}\d{6}\([0-9A]\)"),
    ("NIK", r"\b\d{16}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b\+?\d[\d\s\-().]{7,}\d\b"),
)
RECOGNIZERS = (
    ("NRIC", r"[STFGM]\d{7}[A-Z]", 0.85),
    ("MYKAD", r"\d{6}-\d{2}-\d{4}", 0.85),
    ("HKID", r"[A-Z]{1,2}\d{6}\([0-9A]\)", 0.85),
    ("NIK", r"\d{16}", 0.8),
)
NARROW_CHARS, WIDE_CHARS = " \t.,:;'\"|!()[]{}ijl", "MWmw@"
DIGIT_WIDTH, NARROW_WIDTH, WIDE_WIDTH, PLAIN_WIDTH = 0.85, 0.45, 1.5, 1.0
LOCALE_LANGUAGES = {"sg": ["en"], "my": ["en", "ms"], "hk": ["en", "ch_tra", "ch_sim"], "id": ["en", "id"], "us": ["en"]}
DETECTED_LOCALES = {"en": "sg", "ms": "my", "id": "id", "zh-cn": "hk", "zh-tw": "hk"}
OCR_CODES = {"en": "eng", "eng": "eng", "ms": "msa", "id": "ind", "ch_sim": "chi_sim", "ch_tra": "chi_tra"}
PADDING_PX = {"good": 4, "mild": 8, "severe": 12}
CONFUSIONS = ("0158|", "olsbl")
USER_RATIO, AUTO_RATIO, STRIPPED_RATIO, STRIPPED_LEAST = 0.90, 0.85, 0.92, 6
UNAMBIGUOUS_RATIO, UNAMBIGUOUS_MARGIN = 0.60, 0.10
LABEL_LENGTHS = (6, 8, 12, 16, 32, 64)
