"""Fixed word lists, units, labels and weights that results depend on."""

# Fixed values.
PANEL_LEXICON = ["COMPREHENSIVE METABOLIC PANEL", "CMP", "BASIC METABOLIC PANEL", "BMP", "COMPLETE BLOOD COUNT", "CBC", "CBC WITH DIFFERENTIAL", "LIPID PANEL", "TSH", "THYROID STIMULATING HORMONE"]
PANEL_WORDS = "CMP|COMPREHENSIVE METABOLIC|CBC|COMPLETE BLOOD COUNT|LIPID|TSH|THYROID|BASIC METABOLIC PANEL|BMP"
ANALYTES = ["sodium", "potassium", "chloride", "co2", "calcium", "glucose", "bun", "creatinine", "albumin", "total protein", "ast", "alt", "alk phos", "bilirubin", "wbc", "rbc", "hemoglobin", "hgb", "hematocrit", "hct", "mcv", "mch", "mchc", "rdw", "platelets", "plt", "cholesterol", "triglycerides", "hdl", "ldl", "vldl", "non-hdl", "tsh", "free t4", "free t3"]
VALUE_UNIT = "(?i)[0-9]+([.][0-9]+)?[ \t]*(mg/dL|mmol/L|IU/L|U/L|g/dL|%|x10[\\^][0-9]+|pg/mL|ng/mL|fL|pg)"
UNIT_AFTER_VALUE = "(?i)(mg/dL|mmol/L|g/dL|IU/L|U/L|pg/mL|ng/mL|x10[\\^][0-9]+|%|fL|pg)"
MEDICAL_UNITS = ["mg/dL", "g/dL", "g/L", "mg/L", "mcg/dL", "mcg/L", "ng/mL", "pg/mL", "mmol/L", "umol/L", "nmol/L", "pmol/L", "mEq/L", "IU/L", "U/L", "mU/L", "uU/mL", "mIU/L", "uIU/mL", "mL/min/1.73", "K/uL", "M/uL", "cells/uL", "10^3/uL", "10^6/uL", "10^9/L", "x10^3/uL", "x10^6/uL", "thou/uL", "mill/uL", "%", "percent", "ratio", "index", "score", "units", "sec", "seconds", "min", "minutes", "hr", "hours", "day", "days", "mmHg", "cmH2O", "kPa", "C", "F", "mL", "L", "uL", "dL", "g", "kg", "mg", "ug", "ng", "pg", "IU", "U", "mU", "uU", "KU", "MU", "fL", "copies/mL", "cells/mL", "cm", "mm", "bpm"]
SCORED_UNITS = [u for u in MEDICAL_UNITS if u not in ("uIU/mL", "mL/min/1.73", "fL", "copies/mL", "cells/mL", "cm", "mm", "bpm")]
HEADER_MARKS = ["specimen[ ]+id[ ]*:", "accession", "acct[ ]*#", "mrn", "patient[ ]+id", "phone", "fax", "rte", "clia", "npi", "director", "location", "collected", "received", "entered", "reported"]
STOP_WORDS = ["the", "and", "or", "in", "on", "at", "to", "for"]
ALLOWED_UNITS = {
    "WBC": ["x10E3/uL", "10^3/uL", "10e3/uL"],
    "RBC": ["x10E6/uL", "10^6/uL", "10e6/uL"],
    "HGB": ["g/dL"],
    "HCT": ["%"],
    "PLT": ["x10E3/uL", "10^3/uL", "10e3/uL"],
    "GLUCOSE": ["mg/dL", "mmol/L"],
    "SODIUM": ["mmol/L"],
    "POTASSIUM": ["mmol/L"],
    "TSH": ["uIU/mL", "mIU/L"],
}
UNIT_SPELLINGS = [("x10E3/uL", "10^3/uL"), ("x10e3/uL", "10^3/uL"), ("10e3/uL", "10^3/uL"), ("x10E6/uL", "10^6/uL"), ("x10e6/uL", "10^6/uL"), ("10e6/uL", "10^6/uL")]
MEDICAL_TERMS = ["glucose", "sodium", "potassium", "chloride", "cholesterol", "triglyceride", "hemoglobin", "hematocrit", "platelet", "white", "red", "cell", "count", "protein", "albumin", "globulin", "bilirubin", "creatinine", "urea", "enzyme", "hormone", "vitamin", "mineral", "electrolyte", "lipid"]
ROLE_RULES = [
    ("HEADER_PATIENT_NAME", ["patient:", "patient name"]),
    ("HEADER_PATIENT_DEMO", ["dob:", "date of birth", "sex:", "mrn:"]),
    ("HEADER_PATIENT_CONTACT", ["address:", "phone:", "street", "city"]),
    ("HEADER_ORDERING", ["ordering", "physician", "doctor", "provider"]),
    ("HEADER_LAB", ["laboratory", "lab:", "clia:", "performing"]),
    ("HEADER_SPECIMEN", ["specimen", "collected", "accession"]),
]
SERVED_ROLES = ["PAGE_HEADER", "PAGE_FOOTER", "HEADER_PATIENT", "HEADER_SPECIMEN", "SECTION_PANEL", "TEST_ROW", "COMMENT", "SECTION_MISC", "JUNK"]
JOB_STATUSES = ["queued", "processing", "completed", "failed", "cancelled"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
KNOWN_UNITS = ["mg/dl", "g/dl", "mmol/l", "uiu/ml", "iu/l", "ng/ml", "pg/ml", "u/l", "k/ul", "m/ul", "%", "mcg/dl", "ug/dl", "mg/l", "g/l", "copies/ml", "fl", "pg", "iu"]
MEDICAL_WORDS = ["lab", "laboratory", "pathology", "clinical", "medical", "health", "test", "specimen", "patient", "doctor", "physician", "md", "clia"]
LABEL_WORDS = ["patient", "name", "dob", "birth", "sex", "gender", "male", "female", "mrn", "id", "number", "account", "accession", "specimen", "sample", "collected", "received", "reported", "date", "time", "doctor", "physician", "provider", "ordering", "clinic", "lab", "laboratory", "clia", "address", "phone", "fax", "director", "report"]
PANEL_INDICATORS = ["comprehensive metabolic panel", "cmp", "complete blood count", "cbc", "lipid panel", "liver function", "kidney function", "thyroid", "basic metabolic panel", "bmp", "electrolytes", "chemistry"]
HEADER_TERMS = ["Specimen ID", "Acct #", "Phone", "Client", "Rte"]
GUARD_UNITS = ["mg/dL", "g/dL", "mEq/L", "mmol/L", "uIU/mL", "IU/L", "ng/mL", "pg/mL", "mcg/dL", "ug/dL", "mg/L", "g/L", "%", "ratio", "index", "units/L", "U/L", "mU/L", "fL", "pg", "K/uL", "M/uL", "cells/uL", "per hpf", "copies/mL", "cells/mL", "mg", "g", "mL", "L", "cm", "mm", "bpm"]
CODE_FORM = "(?i)(?:^|[^A-Za-z0-9_]){kind}[ \t]*[:#]?[ \t]*([A-Za-z0-9-]+)"
HEADER_HINTS = ["patient", "specimen", "lab", "report", "results", "test", "name:", "dob:", "mrn:", "accession:", "collected:", "received:", "provider:", "location:", "status:", "reference", "range", "panel", "profile", "chemistry", "hematology", "urinalysis"]
EXPECTED_PANELS = "(?i)CBC.*With.*Differential|Comprehensive.*Metabolic.*Panel|CMP|Complete.*Blood.*Count"
FOOTNOTE_MARKS = "([*†‡§¶#]|\\[[0-9]+\\]|\\([0-9]+\\))"
FILE_KINDS = {".pdf": "pdf", ".docx": "docx", ".png": "image", ".jpg": "image", ".jpeg": "image"}
ASSIGNED_PANELS = "(?i)\\b(CMP|COMPREHENSIVE METABOLIC PANEL|CBC|COMPLETE BLOOD COUNT|LIPID PANEL|TSH|THYROID|BASIC METABOLIC PANEL|BMP|LIVER FUNCTION|KIDNEY FUNCTION|ELECTROLYTES|CHEMISTRY)\\b"
ASSIGNED_UNITS = "(?i)\\b[0-9]+[.]?[0-9]*[ \\t]*(mmol|mEq|IU|U/L|ng/mL|mg/dL|g/dL|mcg/dL|µg/L|pg/mL|x10\\^[0-9]+|%|cells/µL|fL|pg|g/L|mL|L|U|ng|mg|mcg|µg|cells|K/µL|/µL|/uL|per µL|per uL)\\b"
SPLIT_NAMES = [r"^([A-Za-z][A-Za-z0-9\s\-,\(\)]+?)\s*(?=\d|<|>|\*)", r"^([A-Za-z][A-Za-z\s\-,\(\)]+?)\s+(?=\d)", r"^([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*(?=\d)"]
SPLIT_STAGES = {
    "FLAG": [r"(\*+)", r"\b(HIGH|LOW|H|L)\b", r"\b(CRITICAL|PANIC)\b", r"\b(ABNORMAL|ABN)\b", r"(\!+)"],
    "VALUE": [r"(\d+\.?\d*)", r"(<\s*\d+\.?\d*)", r"(>\s*\d+\.?\d*)", r"(\d+\.?\d*\s*-\s*\d+\.?\d*)", r"(NEGATIVE|POSITIVE|NEG|POS)", r"(NORMAL|ABNORMAL|HIGH|LOW)", r"(DETECTED|NOT\s+DETECTED)"],
    "UNIT": [r"\b(mg/dL|g/dL|mmol/L|mEq/L|U/L|IU/L|ng/mL|pg/mL|μg/dL|mcg/dL)", r"\b(K/uL|M/uL|cells/uL|/uL)", r"\b(mm/hr|mmHg|bpm|%|ratio)", r"\b(mg|g|mL|L|units|IU)"],
    "REF_RANGE": [r"(\d+\.?\d*\s*-\s*\d+\.?\d*)", r"(<\s*\d+\.?\d*)", r"(>\s*\d+\.?\d*)", r"(\d+\.?\d*\s*-\s*\d+\.?\d*\s+[A-Za-z/]+)", r"(NEGATIVE|NOT\s+DETECTED)"],
}
# Thresholds and weights: fixed values too.
STITCH_GAP = 28  # units of x between cells that are one row
LOW_CONFIDENCE = 0.7
FIELD_FLOORS = {"name": 0.4, "value": 0.6, "unit": 0.6, "range": 0.5}
LEAST_CONTINUITY, WEAK_CONTINUITY = 0.25, 0.5
ROW_TOLERANCE = 6  # thousandths of the page height
ROW_WEIGHTS = {"value": 0.3, "unit": 0.25, "range": 0.2, "name": 0.15, "classifier": 0.1}
PANEL_WEIGHTS = (0.5, 0.25, 0.25)
DOCUMENT_WEIGHTS = (0.6, 0.3, 0.1)
PANEL_REVIEW, DOCUMENT_REVIEW = 0.7, 0.75
FIELD_ALIASES = {
    "vendor_name": ["vendor.name", "/vendor/name", "payee.name"],
    "patient_first_name": ["patient.first_name", "/patient/first_name"],
    "patient_last_name": ["patient.last_name", "/patient/last_name"],
    "test_name": [],
    "result_value": [],
    "units": [],
    "reference_range": [],
    "flag": [],
    "header_label": [],
    "header_value": [],
}
REQUIRED_FIELDS = ["vendor_name"]
# Word lists of header lines.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
FIRST_NAMES = [
    "james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "christopher", "charles", "daniel", "matthew", "anthony", "mark", "donald", "steven", "paul", "andrew", "joshua", "kenneth", "kevin", "brian", "george", "timothy", "ronald", "jason", "edward", "jeffrey", "ryan", "jacob",
    "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "nancy", "lisa", "betty", "helen", "sandra", "donna", "carol", "ruth", "sharon", "michelle", "laura", "kimberly", "deborah", "dorothy",
    "mike", "dave", "steve", "chris", "bob", "bill", "tom", "jim", "joe", "sue", "beth", "liz", "kate", "ann", "lynn", "pat", "jan", "kim",
]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "rn", "do"]
NAME_LABELS = [r"patient\s*(?:name|id|number)", r"medical\s*record", r"date\s*of\s*birth", r"hospital\s*name", r"doctor\s*name", r"physician\s*name", r"lab\s*name", r"test\s*name"]
NO_NAMES = ["patient", "name", "male", "female", "date", "time", "hospital", "clinic", "doctor", "physician"]
NO_NUMBERS = ["specimen", "sample", "number", "accession", "lab", "test", "blood", "urine"]
NUMBER_PREFIXES = ["lab", "acc", "accession", "specimen", "spec", "sample", "samp", "test", "order", "req", "request", "case", "path", "cyto", "hist", "micro", "chem", "heme", "coag", "immuno", "molec"]
PATIENT_WORDS = ["patient", "name", "pt", "ptnt", "person", "individual", "client", "subject", "case", "record", "mrn", "medical record number", "account", "id", "identifier", "sex", "gender", "male", "female", "man", "woman", "boy", "girl", "m", "f", "masculine", "feminine"]
SPECIMEN_WORDS = [
    "blood", "serum", "plasma", "urine", "stool", "sputum", "csf", "cerebrospinal fluid", "saliva", "swab", "tissue", "biopsy", "fluid", "aspirate", "lavage", "washing",
    "tube", "vial", "container", "cup", "bottle", "bag", "syringe", "capillary", "microtainer", "vacutainer", "edta", "heparin",
    "collected", "collection", "drawn", "obtained", "taken", "received", "entered", "processed", "analyzed", "reported", "completed", "finalized", "verified", "reviewed",
]
TIME_WORDS = ["am", "pm", "morning", "afternoon", "evening", "night", "midnight", "noon", "o'clock"]
DATE_WORDS = ["on", "at", "date", "time", "dated", "timestamp", "when", "during"]
