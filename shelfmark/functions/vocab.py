"""Fixed values.

Everything in this file is data, not logic: word lists, lookup tables and limits whose exact content decides the results.
"""

# ---- categories -------------------------------------------------------------------------------------------------------
UNSORTED = "Unsorted_Miscellaneous"
UNSORTED_CODE = "80.01"
UNSORTED_PROFILE = {
    "description": "Fallback bucket for files that do not confidently fit the active taxonomy.",
    "aliases": ["unsorted", "miscellaneous", "triage", "review needed"],
    "positive_examples": ["unknown file.tmp", "misc document.pdf", "review later.txt"],
}

# ---- rule-based folders and junk --------------------------------------------------------------------------------------
SAFE_DIR = "_Temp_Safe_To_Remove"
REVIEW_DIR = "_Temp_Review_First"
SOFTWARE_DIR = "_Software_Projects"
MANAGED_DIRS = [SAFE_DIR, REVIEW_DIR, SOFTWARE_DIR]
MANAGED_PATTERN = r"^\d{2}\.\d{2}_"
SAFE_NAMES = ["thumbs.db", "desktop.ini", ".ds_store"]
SAFE_EXT = [".tmp", ".temp", ".pyc", ".pyo"]
REVIEW_EXT = [".bak", ".old", ".log", ".dmp", ".part", ".crdownload", ".swp", ".chk", ".cache"]
PROJECT_MARKERS = [".git", "node_modules"]
PACKAGE_MARKER = "site-packages"
LIB_DIRS = ["lib", "lib64"]
ENV_DIRS = ["venv", ".venv", "env", ".env", "virtualenv"]

# Words that carry no information about a file.
GENERIC_WORDS = (
    "scan scanned scanner document documents doc docs image images img photo photos pic pics picture pictures file files "
    "download downloads copy new untitled microsoft word excel text screenshot dsc pxl vid video audio recording whatsapp "
    "tmp temp backup misc other stuff old folder desktop data pdf docx jpg jpeg png page"
).split()

FILE_KINDS = {
    "image": "jpg jpeg png gif bmp webp tif tiff heic cr2 raw",
    "video": "mp4 mkv avi mov wmv flv m4v webm ts",
    "audio": "mp3 wav flac aac m4a ogg wma m4b au",
    "document": "pdf doc docx txt rtf odt",
    "spreadsheet": "xls xlsx xlsm csv ods",
    "presentation": "ppt pptx",
    "ebook": "epub mobi djvu azw3",
    "subtitle": "srt sub vtt",
    "code": "py js java c cpp cs html css ipynb sql json xml yml",
    "program": "exe msi dll",
    "archive": "zip rar 7z tar gz iso",
    "data": "dat db bin pak",
}

# ---- term evidence ----------------------------------------------------------------------------------------------------
NOISE_STOPWORDS = "and the for with copy document untitled new folder file from to of in on a an by or".split()
NOISE_SCAFFOLDING = "users user admin desktop downloads documents drive onedrive session root".split()
NOISE_PACKAGING = (
    "tmp cache caches resources bin lib libs share common data objects deps build dist portable release debug installer "
    "install setup x64 x86 64 32 windows node_modules __pycache__"
).split()
NOISE_FORMAT = "json xml dll exe zip png jpg jpeg svg pdf doc docx txt csv xlsx xls pyc".split()
NOISE_FACTORS = {"stopword": 0.15, "path_scaffolding": 0.35, "packaging": 0.22, "format": 0.18}
BUNDLE_MARKERS = "resources cache caches tmp bin lib share common objects deps build dist __pycache__".split()
BUNDLE_MIN_REFS = 40
BUNDLE_MIN_RATIO = 0.18
BUNDLE_PENALTY = 0.25
SOURCE_WEIGHTS = {"filename": 3.0, "parent": 2.2, "higher_path": 1.4, "format_package": 0.6}
PHRASE_WEIGHTS = {"phrase_filename": 3.2, "phrase_path": 2.0}

# ---- thresholds -------------------------------------------------------------------------------------------------------
DENSE_THRESHOLD = 0.18
LEAD_THRESHOLD = 0.01
UNSORTED_OVERRIDE = 0.12
FIRST_PASS = {"lead": 0.03, "vote_share": 0.9}
SETTING_LIMITS = {"lead": (0.0, 0.05), "vote_share": (0.5, 1.0), "min_files": (5, 200)}
GUARD_DIVISOR = 150
GRID_DENSE = [0.18, 0.22, 0.26, 0.30, 0.34]
GRID_LEAD = [0.02, 0.04, 0.06, 0.08]
GRID_OVERRIDE = [0.12, 0.16, 0.20, 0.24]
COARSE_GROUPS = {
    "Identity_Documents": "identity",
    "Legal_Case_Files": "legal",
    "Financial_Receipts_Bills": "receipts",
    "Study_Notes_Exam_Prep": "study",
    "Unsorted_Miscellaneous": "mixed_weak",
}
OVERBROAD_SHARE = 0.40
MISSING_TERM_WEIGHT = 1500
RULE_BUCKETS = ["_Software_Projects", "_Temp_Safe_To_Remove"]

# ---- names ------------------------------------------------------------------------------------------------------------
MAX_NAME = 170
IMAGE_EXT = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff"]
DATA_EXT = [".txt", ".csv", ".json", ".xml", ".py", ".js", ".ts"]
DOC_EXT = [".doc", ".docx", ".pdf"]
CONFIG_EXT = [".properties", ".ini", ".cfg", ".yaml", ".yml", ".toml"]
TECHNICAL_EXT = [".dwg", ".dxf", ".rvt", ".rfa", ".bak", ".pcp", ".skp"]
MEDIA_EXT = [".mp3", ".wav", ".flac", ".m4a", ".mp4", ".mkv", ".avi", ".htm", ".html"]

WEAK_NAMES = [
    r"^\d+$",
    r"^[a-f0-9-]{8,}$",
    r"^filename(?:[_ -]?\d+)?(?: \(\d+\))?$",
    r"^downloaded(?:[_ -].*)?$",
    r"^null(?:[_ -]?\d+)?$",
    r"^unknown(?:[_ -].*)?$",
    r"^document(?:[_ -]?\d+)?$",
    r"^file(?:[_ -]?\d+)?$",
    r"^new[_ -]?document.*$",
    r"^viewpdfservlet.*$",
]
NAME_STOPWORDS = (
    "a an and copy document documents downloaded file final for from image images new of on or scan temp the to untitled "
    "with aadhaar adhar aadhar card certificate marksheet salary appointment letter migration voter id dob degree domicile "
    "panjikarn www com flv2mp3"
).split()
NOISE_TOKENS = [r"\bwww\b", r"\bflv2mp3\b", r"\bupload[_ -]?\w+\b"]
RAW_NAMES = [
    r"\badhar\b", r"\baadhar\b", r"\blicience\b", r"\blicence\b", r"\bform[_ -]?pdf\b", r"\bviewpdfservlet\b",
    r"\bscan(?:ned)?\b", r"\bwhatsapp\s+image\b", r"\bimg[-_ ]?\d+\b",
]
BENIGN_SUFFIXES = ["copy", "scanned", "scan", "final"]

DOC_TYPES = [
    ("MigrationCertificate", [r"\bmigration\s+certificate\b", r"\bcertificate\s+of\s+migration\b"]),
    ("ProvisionalCertificate", [r"\bprovisional\s+certificate\b"]),
    ("DegreeCertificate", [r"\bbachelors?\s+degree\b", r"\bdegree\b"]),
    ("BirthCertificate", [r"\bdob\b", r"\bdate\s+of\s+birth\b", r"\bbirth\s+certificate\b"]),
    ("DomicileCertificate", [r"\bdomicile\b"]),
    ("AadhaarCard", [r"\baadhaar\b", r"\badhar\b", r"\baadhar\b", r"\badharcard\b"]),
    ("PANCard", [r"\bpan\b"]),
    ("DrivingLicence", [r"\bdriving\s+licen[cs]e\b", r"\bdl\b"]),
    ("VoterID", [r"\bvoter\s+id\b", r"\belection\s+card\b"]),
    ("GoldenCard", [r"\bgolden\s+card\b"]),
    ("PhotoID", [r"\bphoto\s*id\b"]),
    ("Marksheet", [r"\bmarksheet\b", r"\bmark\s*sheet\b"]),
    ("SalarySlip", [r"\bsalary\b", r"\bsalary\s+slip\b"]),
    ("BankStatement", [r"\bbank\s+statement\b"]),
    ("ChallanReceipt", [r"\bchallan\s+receipt\b"]),
    ("ChallanStatement", [r"\bchallan\s+statement\b"]),
    ("TaxAcknowledgement", [r"\back(?:nowledgement)?\b", r"\btax\s+ack(?:nowledgement)?\b"]),
    ("ITRForm", [r"\bitr\s*form\b", r"\bform\s+itr\b", r"\bform_pdf\b"]),
    ("ITRV", [r"\bitrv\b", r"\bitr-v\b", r"\bverification\b"]),
    ("Invoice", [r"\binvoice\b"]),
    ("Receipt", [r"\breceipt\b"]),
    ("ElectricityBill", [r"\belectricity\s+bill\b"]),
    ("WaterBill", [r"\bwater\s+bill\b", r"\bpeyjal\b"]),
    ("Bill", [r"\bbill\b"]),
    ("Policy", [r"\bpolicy\b"]),
    ("AppointmentLetter", [r"\bappointment\s+letter\b"]),
    ("Application", [r"\bapplication\b"]),
    ("Agreement", [r"\bagreement\b"]),
    ("AdmitCard", [r"\badmit\s+card\b"]),
    ("QuestionPaper", [r"\bquestion\s+paper\b"]),
    ("AnswerKey", [r"\banswer\s+key\b"]),
    ("SubmittedAnswers", [r"\bsubmitted\s+answers?\b", r"\bsubmitedanswer\b"]),
    ("Resume", [r"\bresume\b"]),
    ("CV", [r"\bcv\b"]),
    ("ResearchProposal", [r"\bresearch\s+proposal\b"]),
    ("Haemogram", [r"\bhaemogram\b", r"\bcbc\b"]),
    ("Cytology", [r"\bcytology\b", r"\bbal\b"]),
    ("Report", [r"\breport\b"]),
    ("Notes", [r"\bnotes?\b"]),
    ("Lecture", [r"\blecture\b", r"\blec\d*\b"]),
    ("Module", [r"\bmodule\b", r"\bmod\d*\b"]),
    ("Checklist", [r"\bchecklist\b"]),
    ("Index", [r"\bindex\b"]),
    ("Certificate", [r"\bcertificate\b"]),
    ("EmploymentRegistration", [r"\bpanjikarn\b", r"\bemployment\s+registration\b"]),
    ("Guide", [r"\bguide\b"]),
    ("Book", [r"\bbook\b"]),
    ("Data", [r"\bdata\b"]),
    ("Screenshot", [r"\bscreenshot\b"]),
    ("Photo", [r"\bphoto\b"]),
]
ISSUERS = [
    ("UIDAI", [r"\buidai\b", r"\baadhaar\b", r"\badhar\b", r"\baadhar\b"]),
    ("SBI", [r"\bsbi\b", r"\bstate\s+bank\b"]),
    ("UPCL", [r"\bupcl\b"]),
    ("GATE", [r"\bgate\b"]),
    ("UKPSC", [r"\bukpsc\b"]),
    ("ICICI", [r"\bicici\b"]),
    ("IFMS", [r"\bifms\b"]),
    ("ISKCON", [r"\biskcon\b"]),
    ("Portronics", [r"\bportronic?s\b"]),
    ("Autodesk", [r"\bautodesk\b"]),
    ("Revit", [r"\brevit\b"]),
    ("UIDAI", [r"\baadhaar\s+card\b", r"\badhar\s+card\b"]),
]
STATUSES = [
    ("Draft", [r"\bdraft\b"]),
    ("Final", [r"\bfinal\b"]),
    ("Ocr", [r"\bocr(?:ed)?\b"]),
    ("Recovered", [r"\brecovered\b"]),
    ("Prefilled", [r"\bprefilled\b"]),
]
VERSIONS = [
    ("Rev", r"\brev(?:ision)?[_ -]?(\d+)\b"),
    ("V", r"\bv(?:er(?:sion)?)?[_ -]?(\d+)\b"),
    ("Part", r"\bpart[_ -]?(\d+)\b"),
    ("Module", r"\bmodule[_ -]?(\d+)\b"),
    ("Module", r"\bmod[_ -]?(\d+)\b"),
    ("Lec", r"\blec(?:ture)?[_ -]?(\d+)\b"),
]
MONTHS = {
    "january": "01", "jan": "01", "february": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04",
    "may": "05", "june": "06", "jun": "06", "july": "07", "jul": "07", "august": "08", "aug": "08", "september": "09",
    "sept": "09", "sep": "09", "october": "10", "oct": "10", "november": "11", "nov": "11", "december": "12", "dec": "12",
}
GENERIC_TYPES = ["Document", "MediaFile", "Data", "Photo"]
TITLE_TYPES = ["Report", "Book", "Guide", "Notes", "Lecture", "Module"]
TITLE_MARKERS = ["of", "from", "on", "with", "part", "song", "report", "earthquake", "landmarks"]
PHRASE_PAIRS = [
    "bank statement", "annual report", "floor plan", "flight dynamics", "migration certificate", "provisional certificate",
    "birth certificate", "question paper", "answer key", "legal notice", "court order", "code book", "steel design",
    "data pipeline", "leave policy", "stock market", "sponsorship policy", "service bulletin", "missile guidance",
    "earnings call",
]
# A counted word keeps its number: "module 3" -> Module3.  Alphabetic words of up to four letters do so in any case.
COUNTED_WORDS = ["module", "part", "level", "rev", "revision", "q", "quarter", "lec", "lecture"]

IDENTITY_TYPES = [
    "AadhaarCard", "PANCard", "DrivingLicence", "VoterID", "GoldenCard", "PhotoID", "BirthCertificate", "DomicileCertificate",
]
FINANCIAL_TYPES = [
    "BankStatement", "ChallanReceipt", "ChallanStatement", "TaxAcknowledgement", "ITRForm", "ITRV", "Invoice", "Receipt",
    "ElectricityBill", "WaterBill", "Bill", "Policy",
]
ACADEMIC_TYPES = [
    "Marksheet", "Certificate", "ProvisionalCertificate", "MigrationCertificate", "DegreeCertificate", "AdmitCard",
    "QuestionPaper", "AnswerKey", "SubmittedAnswers", "ResearchProposal", "Application", "Checklist", "Index",
]
STUDY_TYPES = ["Notes", "Lecture", "Module", "Guide", "Book"]
TECHNICAL_TYPES = ["Agreement", "Report"]
# class -> (document types, extensions, role order, required roles)
PATTERN_CLASSES = {
    "identity_personal": (IDENTITY_TYPES, [], ["name", "type", "issuer", "date", "version", "status"], ["type"]),
    "financial_tax": (FINANCIAL_TYPES, [], ["name", "type", "issuer", "id", "date", "version", "status"], ["type"]),
    "academic_certificate": (ACADEMIC_TYPES, [], ["name_or_topic", "type", "issuer", "date", "version", "status"], ["type"]),
    "study_reference": (STUDY_TYPES, [], ["topic", "type", "issuer", "date", "version", "status"], ["topic", "type"]),
    "technical_project": (TECHNICAL_TYPES, TECHNICAL_EXT, ["project", "type", "subject", "version", "date", "status"], ["project"]),
    "media_title": ([], MEDIA_EXT, ["artist", "title", "part", "date"], ["title"]),
}
LENIENT_CLASSES = ["identity_personal", "financial_tax", "academic_certificate"]
# Document types whose name may start with the person it belongs to (the financial types too).
PERSON_TYPES = IDENTITY_TYPES + [
    "Marksheet", "Certificate", "ProvisionalCertificate", "MigrationCertificate", "DegreeCertificate", "TaxAcknowledgement",
    "ITRForm", "ITRV", "AppointmentLetter",
] + FINANCIAL_TYPES

# ---- rules about chunks of names --------------------------------------------------------------------------------------
# Fixed values: (words that must all occur, what they stand for), the first one that fits; words that make a chunk a title.
ARTIFACTS = [(["floor", "plan"], "FloorPlan"), (["model"], "Model"), (["layout"], "Layout"), (["design", "plot"], "PlotDesign"), (["report"], "Report")]
NUMBERED_ARTIFACT = ("FloorPlan", "level", "FloorPlan_Level")
TITLE_CHUNKS = ["report", "notes", "book", "policy", "analysis", "design"]

# Evidence phrases have two or three words.
PHRASE_WORDS = 3

# ---- contextual names -------------------------------------------------------------------------------------------------
CONTEXT_STOPWORDS = (
    "a an and are as at be by copy doc docx file for from gif in image images jpeg jpg json new of on or pdf png scan temp "
    "text the this to txt untitled version webp with xml zip downloads"
).split()
VAGUE_NAMES = [
    r"^\d+$", r"^[a-f0-9-]{8,}$", r"^img[_-]?\d+$", r"^image[_-]?\d+$", r"^document[_ -]?\d*$", r"^new[_ -]?document.*$",
    r"^scan[_ -]?\d*$",
]
VAGUE_MARKERS = ["copy", "document", "file", "image", "scan", "temp", "new", "untitled"]
SERIAL_NAME = r"(?i)^(\d{1,6}(?:_[a-z0-9]*)*)$"
TOPIC_SCORE = 0.20

# ---- dates in names ---------------------------------------------------------------------------------------------------
# The forms of dates, in order of precedence; (kind, pattern, groups of year, month and day, century to put before).
MONTH_WORDS = "|".join(MONTHS)
DATE_FORMS = [
    ("day", r"\b(20\d{2})[-_](\d{2})[-_](\d{2})\b", (1, 2, 3), ""),
    ("day", r"(?<!\d)(\d{2})[-_. ](\d{2})[-_. ](20\d{2})(?!\d)", (3, 2, 1), ""),
    ("month", r"\b(20\d{2})[-_](\d{2})\b", (1, 2), ""),
    ("day", r"\b(\d{2})(\d{2})(20\d{2})\b", (3, 2, 1), ""),
    ("day", r"\b(\d{2})(\d{2})(\d{2})\b", (3, 2, 1), "20"),
    ("word", rf"(?i)\b({MONTH_WORDS})[ _.-]*(20\d{{2}})\b", (2, 1), ""),
    ("year", r"\b(20\d{2})\b", (1,), ""),
    ("month", r"\b(\d{4})[-_](\d{2})\b", (1, 2), ""),
]
MONTH_SPAN = rf"(?i)\b({MONTH_WORDS})[ _.-]+(?:to[ _.-]+)?({MONTH_WORDS})[ _.-]*20\d{{2}}"
