"""Fields of a document's head, each from the first line that has it: laboratory, patient, ordering, specimen, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import text as T
from panelspark.operators.stitch import settled

# Roles and forms of fields.
LAB_ROLES = ("PAGE_HEADER", "HEADER_LAB", "SECTION_PANEL")
PATIENT_ROLES = ("HEADER_PATIENT", "PATIENT_INFO", "DEMOGRAPHICS")
ORDERING_ROLES = ("HEADER_PHYSICIAN", "ORDERING_PROVIDER", "PHYSICIAN_INFO")
PHONE = r"(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})"
LAB_NAMES = [
    r"(?i)([A-Z][a-z]+ (?:Laboratory|Lab|Medical Center|Health)(?:\s+[A-Z][a-z]+)*)",
    r"(?i)([A-Z][A-Z\s]+(?:LABORATORY|LAB|MEDICAL)(?:\s+[A-Z]+)*)",
    "(?i)(Quest Diagnostics|LabCorp|BioReference|ARUP|Mayo)",
]
ACCOUNT = r"(?i)(?:Account|Acct|Client)[\s#:]*([A-Z0-9-]+)"
NAME_COMMA = r"(?i)(?:Patient|Name)[\s:]*([A-Z][a-z]+),\s*([A-Z][a-z]+)(?:\s+([A-Z][a-z]+))?"
NAME_PLAIN = r"(?i)(?:Patient|Name)[\s:]*([A-Z][a-z]+)\s+(?:([A-Z][a-z]+)\s+)?([A-Z][a-z]+)"
BIRTH = r"(?i)(?:DOB|Date of Birth|Born)[\s:]*([^,\n]+)"
SEX = r"(?i)(?:Sex|Gender)[\s:]*([MF]|Male|Female)"
RECORD = [r"(?i)(?:MRN|Medical Record|Patient ID|ID)[\s#:]*([A-Z0-9-]+)", r"(?i)(?:Account|Acct)[\s#:]*([0-9-]+)"]
PROVIDER = [
    r"(?i)(?:Ordering|Referring|Physician|Provider|Dr|MD)[\s:]*([A-Z][a-z]+(?:,?\s+[A-Z][a-z.]+)*(?:\s+MD|DO)?)",
    r"(?i)(?:Ordered by|Referring)[\s:]*([A-Z][a-z]+\s+[A-Z][a-z]+)",
]
NPI = r"(?i)\bNPI\s*[:#]?\s*(\d{10})\b"
SPECIMEN = r"(?i)\b(?:Accession|Specimen(?:\s*ID)?)\s*[:#]\s*([A-Z0-9-]+)"
CONTROL = r"(?i)(?:Control|QC)[\s#:]*([A-Z0-9-]+)"
SPECIMEN_TYPE = [r"(?i)(?:Specimen|Sample)[\s:]*([A-Za-z\s]+?)(?:\s|$|,)", "(?i)(Blood|Serum|Plasma|Urine|Stool|Sputum|CSF|Tissue)"]
TIMES = {
    "collected_at": [r"(?i)(?:Collected|Collection)[\s:]*([^,\n]+)"],
    "received_at": [r"(?i)(?:Received)[\s:]*([^,\n]+)"],
    "entered_at": [r"(?i)(?:Entered)[\s:]*([^,\n]+)"],
    "reported_at": [r"(?i)(?:Reported|Report Date)[\s:]*([^,\n]+)", r"(?i)(?:Final|Finalized)[\s:]*([^,\n]+)"],
}
STREET = r"(?i)\d+\s+\w+\s+(street|st|avenue|ave|road|rd|drive|dr|blvd)"
STATE_ZIP = r"[A-Z]{2}\s+\d{5}"
CLINIC = "(?i)(clinic|hospital|medical center|health|practice)"
CLINICAL = r"(?i)clinical\s+information"
COMMENTS = r"(?i)(?:comments|general\s+comments|notes)"
ORDERED = r"(?i)(?:ordered|requested|tests?\s+ordered)"
ORDERED_ITEM = r"([A-Z][A-Za-z\s]+(?:Panel|Test|Profile|Screen))"


@dataclass(frozen=True)
class Field:
    """A field's value on a line (null where there is none), taken from the first line that has one."""

    section: str
    name: str
    value: Column


#: What is looked for in a line, each once, in order: patterns and their groups.
_LOOKED_FOR = {
    "lab": [(p, 1) for p in LAB_NAMES],
    "account": [(ACCOUNT, 1)],
    "number": [(PHONE, 1)],
    **{f"comma{g}": [(NAME_COMMA, g)] for g in (1, 2, 3)},
    **{f"plain{g}": [(NAME_PLAIN, g)] for g in (1, 2, 3)},
    "birth": [(BIRTH, 1)],
    "sex": [(SEX, 1)],
    "record": [(p, 1) for p in RECORD],
    "provider": [(p, 1) for p in PROVIDER],
    "npi": [(NPI, 1)],
    "specimen": [(SPECIMEN, 1)],
    "control": [(CONTROL, 1)],
    "kind": [(p, 1) for p in SPECIMEN_TYPE],
    **{name: [(p, 1) for p in patterns] for name, patterns in TIMES.items()},
}


def _all(name: str) -> list[Column]:
    return [F.nullif(F.col(f"_{name}{i}"), F.lit("")) for i in range(len(_LOOKED_FOR[name]))]


def _first(name: str) -> Column:
    return F.coalesce(*_all(name))


def _looked_for(lines: DataFrame) -> DataFrame:
    """Lines with what each pattern finds, worked out once a line and only on the lines that may have it."""
    out = settled(lines, {"_t": F.trim("text"), "_low": F.lower(F.trim("text"))})
    lab, named = F.col("role").isin(*LAB_ROLES), F.col("role").isin(*PATIENT_ROLES) | F.col("_low").contains("patient")
    only = {"lab": lab, "account": lab} | {f"{form}{g}": named for form in ("comma", "plain") for g in (1, 2, 3)}
    found = {f"_{name}{i}": F.regexp_extract("_t", p, g) for name, some in _LOOKED_FOR.items() for i, (p, g) in enumerate(some)}
    return settled(out, {f"_{name}{i}": F.when(only[name], found[f"_{name}{i}"]) if name in only else found[f"_{name}{i}"] for name, some in _LOOKED_FOR.items() for i in range(len(some))})


def _fields() -> list[Field]:
    """Fields of lines of _looked_for()."""
    role, low = F.col("role"), F.col("_low")
    lab, patient = role.isin(*LAB_ROLES), role.isin(*PATIENT_ROLES)
    number = T.normalize_phone(_first("number"))
    comma = lambda g: _first(f"comma{g}")
    plain = lambda g: _first(f"plain{g}")
    person = F.when(comma(1).isNotNull(), F.struct(comma(1).alias("last_name"), comma(2).alias("first_name"), comma(3).alias("middle")))
    person = person.when(plain(1).isNotNull(), F.struct(plain(3).alias("last_name"), plain(1).alias("first_name"), plain(2).alias("middle")))
    sex = F.upper(_first("sex"))
    kind = F.trim(_first("kind"))
    dated = lambda name: F.coalesce(*(T.normalize_date(x) for x in _all(name)))
    return [
        Field("vendor", "name", F.when(lab, F.trim(_first("lab")))),
        Field("vendor", "account_number", F.when(lab, _first("account"))),
        Field("vendor", "phone", F.when(lab & low.contains("phone"), number)),
        Field("vendor", "fax", F.when(lab & low.contains("fax"), number)),
        # the three names come from one line
        Field("patient", "last_name", person["last_name"]),
        Field("patient", "first_name", person["first_name"]),
        Field("patient", "middle", F.when(person["last_name"].isNotNull(), F.coalesce(person["middle"], F.lit("")))),
        Field("patient", "dob", dated("birth")),
        Field("patient", "sex", F.when(sex.isin("M", "MALE"), "M").when(sex.isin("F", "FEMALE"), "F")),
        Field("patient", "mrn", _first("record")),
        Field("patient", "phone", F.when(patient | low.contains("phone"), number)),
        Field("ordering", "provider_name", F.trim(_first("provider"))),
        Field("ordering", "npi", _first("npi")),
        Field("specimen", "id", _first("specimen")),
        Field("specimen", "control_id", _first("control")),
        Field("specimen", "type", F.when(F.length(kind).between(1, 49), kind)),
        *(Field("specimen", name, dated(name)) for name in TIMES),
    ]


def document_fields(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, role, text) -> doc_id, section, field, value: a row a field that some line has.

    One aggregate by document: the first line's value of every field, whatever their number. A line's values are worked out before it, once.
    """
    fields = _fields()
    valued = settled(_looked_for(lines), {f"f{i}": f.value for i, f in enumerate(fields)})
    firsts = [F.min_by(f"f{i}", F.when(F.col(f"f{i}").isNotNull(), F.col("line_no"))).alias(f"f{i}") for i in range(len(fields))]
    one = valued.groupBy("doc_id").agg(*firsts)
    found = F.array(*(F.struct(F.lit(f.section).alias("section"), F.lit(f.name).alias("field"), F.nullif(F.col(f"f{i}"), F.lit("")).alias("value")) for i, f in enumerate(fields)))
    return one.select("doc_id", F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("x")).select("doc_id", "x.*")


def document_addresses(lines: DataFrame) -> DataFrame:
    """doc_id, section, street, city, state, zip of the laboratory's and the patient's address lines, joined in order."""
    section = F.when(F.col("role").isin(*LAB_ROLES), "vendor").when(F.col("role").isin(*PATIENT_ROLES), "patient")
    some = lines.withColumn("section", section).where(F.col("section").isNotNull() & (F.col("text").rlike(STREET) | F.col("text").rlike(STATE_ZIP)))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return some.groupBy("doc_id", "section").agg(T.split_address(block).alias("a")).select("doc_id", "section", "a.*")


def ordering_locations(lines: DataFrame) -> DataFrame:
    """doc_id, name: the first line of the ordering party that names a clinic."""
    hit = F.col("role").isin(*ORDERING_ROLES) & F.col("text").rlike(CLINIC)
    return lines.where(hit).groupBy("doc_id").agg(F.min_by(F.trim("text"), F.col("line_no")).alias("name"))


def ordered_items(lines: DataFrame) -> DataFrame:
    """doc_id, items: panels and tests named on lines about orders, distinct and sorted."""
    items = F.transform(F.regexp_extract_all("text", F.lit(ORDERED_ITEM), F.lit(1)), lambda x: F.trim(x))
    some = lines.where(F.col("text").rlike(ORDERED)).select("doc_id", F.explode(items).alias("item")).where(F.col("item") != "")
    return some.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item")), "; ").alias("items"))
