"""Patient charts as free text: sections, values, and the prompt built from them. All as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column
from . import concepts, context

#: Names of the sections of a chart, as regular expressions (fixed values).
SECTION_NAMES = {
    "chief_complaint": r"chief\s+complaint|cc",
    "hpi": r"history\s+of\s+present\s+illness|hpi|presenting\s+complaint",
    "vitals": r"vital\s+signs?|vitals?",
    "physical_exam": r"physical\s+exam(?:ination)?|pe|exam(?:ination)?",
    "labs": r"lab(?:oratory)?\s+results?|labs?|laboratory",
    "imaging": r"imaging|radiology|x-ray|ct\s+scan|mri|echo(?:cardiogr(?:am|aphy))?",
    "medications": r"current\s+med(?:ication)?s?|medications?|meds?",
    "allergies": r"allerg(?:ies|y)|nkda|drug\s+allerg(?:ies|y)",
    "pmh": r"past\s+medical\s+hist(?:ory)?|pmh|medical\s+hist(?:ory)?",
}
#: Where a section ends: at the next heading, or with the text (fixed value).
SECTION_END = r"(?=\n##|\n[A-Z][A-Za-z\s/]{2,20}[:\-]|\z)"
#: Words for no allergy (fixed values).
NO_ALLERGY = ["NKDA", "NONE", "NO KNOWN ALLERGIES", "NKA"]
NO_EVIDENCE = "(No evidence retrieved from the corpus.)"
NO_DISEASES = "(NER aggregator found no candidate diseases in the retrieved chunks.)"
NO_QUESTION = "What is your clinical assessment of this patient?"


def section(text: str | Column, name: str) -> Column:
    """The trimmed text of a section, empty when the chart has none."""
    colon = r"\s*[:\-]?\s*" if name == "allergies" else r"\s*[:\-]\s*"
    found = F.regexp_extract(as_column(text), "(?is)(?:" + SECTION_NAMES[name] + ")" + colon + "(.+?)" + SECTION_END, 1)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def sections(text: str | Column) -> Column:
    return F.struct(*[section(text, n).alias(n) for n in SECTION_NAMES])


def _items(text: Column, separators: str, least: int) -> Column:
    parts = F.transform(F.split(text, separators), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: F.length(x) >= least)


def parse(charts: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``chart``: complaint, symptoms (at most 20), findings, values, person, lists and notes.

    A text without any known section is all notes."""
    with_sections = charts.withColumn("_s", sections(text))
    s = lambda n: F.col(f"_s.{n}")
    some = lambda c: F.when(c != "", c)
    source = F.concat_ws(" ", some(s("chief_complaint")), some(s("hpi")))
    allergy = F.upper(s("allergies"))
    person_text = F.coalesce(some(s("hpi")), some(s("chief_complaint")), F.substring(F.col(text), 1, 500))
    person = context.demographics(person_text)
    nothing = F.coalesce(*[some(s(n)) for n in SECTION_NAMES]).isNull()
    chart = F.struct(
        F.coalesce(some(s("chief_complaint")), F.substring(F.trim(F.split(s("hpi"), "\n")[0]), 1, 200)).alias("chief_complaint"),
        F.slice(F.transform(_items(source, r"[,;\n]", 3), lambda x: F.lower(x)), 1, 20).alias("symptoms"),
        s("physical_exam").alias("physical_findings"),
        context.vitals(F.coalesce(some(s("vitals")), F.col(text))).alias("vitals"),
        F.struct(person["age"].alias("age"), person["sex"].alias("sex"), _items(s("pmh"), r"[,;\n]", 3).alias("comorbidities")).alias("person"),
        s("labs").alias("lab_results"),
        s("imaging").alias("imaging"),
        _items(s("medications"), r"[,\n;]", 3).alias("medications"),
        F.when(allergy.isin(*NO_ALLERGY), F.array().cast("array<string>")).otherwise(_items(s("allergies"), r"[,\n;]", 2)).alias("allergies"),
        F.when(nothing, F.trim(F.col(text))).otherwise("").alias("notes"),
    )
    return with_sections.withColumn("chart", chart).drop("_s")


def serialise(chart: str = "chart") -> Column:
    """A chart as text: a heading and a line for every part that it has."""
    c = lambda n: F.col(f"{chart}.{n}")
    text = lambda head, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"## {head}\n"), v))
    listed = lambda head, v: F.when(F.size(v) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(v, ", ")))
    num = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    value = lambda lead, v, tail="": F.when(v.isNotNull(), F.concat(F.lit(lead), num(v), F.lit(tail)))
    sex = F.when(c("person.sex") == "female", F.lit("F")).when(c("person.sex") == "male", F.lit("M"))
    person = F.concat_ws(" | ", F.concat(c("person.age").cast("string"), F.lit("yo")), sex, F.when(F.size(c("person.comorbidities")) > 0, F.concat(F.lit("PMH: "), F.array_join(c("person.comorbidities"), ", "))))
    pressure = F.when(c("vitals.systolic").isNotNull(), F.concat(F.lit("BP "), num(c("vitals.systolic")), F.lit("/"), num(c("vitals.diastolic"))))
    vitals = F.concat_ws(
        ", ", F.when(c("vitals.temperature").isNotNull(), F.concat(F.lit("T "), c("vitals.temperature").cast("string"), F.lit("°C"))), value("HR ", c("vitals.heart_rate")), pressure,
        value("RR ", c("vitals.respiratory_rate")), value("SpO2 ", c("vitals.spo2"), "%"),
    )
    return F.concat_ws(
        "\n", text("Demographics", person), text("Chief Complaint", c("chief_complaint")), listed("Symptoms", c("symptoms")), text("Physical Findings", c("physical_findings")), text("Vital Signs", vitals),
        text("Lab Results", c("lab_results")), text("Imaging", c("imaging")), listed("Current Medications", c("medications")), listed("Allergies", c("allergies")), text("Additional Notes", c("notes")),
    )


def entities(ner: str | Column, chart: str = "chart") -> Column:
    """Buckets of distinct entity texts by label, with what the chart lists itself, and the concepts of its text."""
    pick = lambda *labels: F.array_distinct(F.transform(F.filter(as_column(ner), lambda e: e["label"].isin(*labels) & (F.trim(e["text"]) != "")), lambda e: F.trim(e["text"])))
    return F.struct(
        F.array_union(pick("PROBLEM", "SYMPTOM"), F.col(f"{chart}.symptoms")).alias("symptoms"),
        F.array_union(pick("TREATMENT"), F.col(f"{chart}.medications")).alias("treatments"),
        pick("TEST").alias("tests"),
        pick("ANATOMY").alias("anatomy"),
        concepts.extract(serialise(chart)).alias("concepts"),
    )


def prompt(chart_text: str | Column, found: str | Column, diseases: str | Column, evidence: str | Column, question: str | Column) -> Column:
    """The user's message of a prompt in its five parts.

    found: what :func:`entities` gives; diseases: array of (rank, name, evidence), of which the first five are shown;
    evidence: the context block, or null."""
    e = as_column(found)
    bucket = lambda name: F.when(F.size(e[name]) > 0, F.concat(F.lit(f"{name}: "), F.array_join(e[name], ", ")))
    summary = F.concat_ws("\n", *[bucket(n) for n in ("symptoms", "treatments", "tests", "anatomy", "concepts")])
    lines = F.transform(F.slice(as_column(diseases), 1, 5), lambda d: F.concat(F.lit("  "), d["rank"].cast("string"), F.lit(". "), d["name"], F.lit(" (evidence chunks: "), d["evidence"].cast("string"), F.lit(")")))
    shown = F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(NO_DISEASES)
    asked = F.trim(F.coalesce(as_column(question), F.lit("")))
    parts = [
        ("Patient Chart", as_column(chart_text)),
        ("Extracted Clinical Entities", summary),
        ("Candidate Diseases (NER aggregator — treat as hint only)", shown),
        ("Retrieved Evidence", F.coalesce(F.when(as_column(evidence) != "", as_column(evidence)), F.lit(NO_EVIDENCE))),
        ("Physician's Question", F.when(asked != "", asked).otherwise(NO_QUESTION)),
    ]
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"### {head}\n"), F.coalesce(body, F.lit(""))) for head, body in parts])


def answer(blocks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer): the first sentence of each of the first blocks with its citation. Stands in for a generator."""
    part = F.concat(F.regexp_extract("text", r"^[^.]*\.?", 0), F.lit(" [CHUNK "), F.col("block").cast("string"), F.lit("]"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))), lambda x: x["p"])
    return blocks.where(F.col("block") <= most).groupBy("query_id").agg(F.array_join(parts, " ").alias("answer"))
