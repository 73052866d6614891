"""Aggregation of ranked chunks into conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import ranking_name
from ..functions.text import as_column
from ..functions.urls import slug_words

#: Headings that name no condition (fixed values).
GENERIC_HEADINGS = [
    "overview", "summary", "introduction", "description", "main", "symptoms", "causes", "diagnosis", "treatment", "prevention", "symptoms and causes",
    "signs and symptoms", "about", "general", "complications", "risk factors", "when to see a doctor", "outlook", "definition", "background", "epidemiology",
]
#: Single words that name no condition by themselves (fixed values).
SINGLE_WORD_NOISE = (
    "blood heart lung lungs kidney kidneys liver brain artery vein vessel tissue muscle bone joint pulmonary cardiac hepatic renal cerebral vascular coronary arterial venous "
    "respiratory intestinal gastric collarbone shoulder knee hip wrist ankle spine pain chest cough fever fatigue dyspnea dyspnoea tachycardia hypoxia hypoxemia syncope nausea "
    "vomiting swelling edema oedema rash bleeding infection inflammation disorder disease syndrome condition abnormality failure insufficiency deficiency lesion mass nodule "
    "effusion stenosis occlusion thrombus clot embolus emboli infarct cancer tumor tumour neoplasm carcinoma necrosis fracture injury trauma wound acute chronic bilateral "
    "unilateral broken injured infected inflamed swollen ruptured torn bruised damaged affected impaired"
).split()


def problems(ner: str | Column, least: float = 0.5) -> Column:
    """Entities that can name a condition, as structs (score, position, text, name), brackets at either end stripped."""
    strip = lambda t: F.regexp_replace(F.trim(t), r"^[\s(\[{<]+|[\s)\]}>]+$", "")
    rows = F.transform(as_column(ner), lambda e, i: F.struct(e["score"].alias("score"), (-i).alias("pos"), strip(e["text"]).alias("text"), ranking_name(strip(e["text"])).alias("name"), e["label"].alias("label")))
    single = lambda t: ~t.contains(" ") & F.lower(t).isin(*SINGLE_WORD_NOISE)
    return F.filter(rows, lambda e: (e["label"] == "PROBLEM") & (F.coalesce(e["score"], F.lit(0.0)) >= least) & (e["text"] != "") & (e["name"] != "") & ~single(e["text"]))


def best_problem(ner: str | Column, least: float = 0.5) -> Column:
    """The entity of the greatest score, the first of equals; null when there is none."""
    return F.array_max(problems(ner, least))


def orphan_name(title: str | Column, url: str | Column, heading: str | Column) -> Column:
    """What to call a chunk without a named condition: title, else the URL's words, else a heading that says something."""
    some = lambda c: F.when(F.trim(as_column(c)) != "", F.trim(as_column(c)))
    h = some(heading)
    return F.coalesce(some(title), F.initcap(slug_words(url)), F.when(~F.lower(h).isin(*GENERIC_HEADINGS), h))


def aggregate(ranked: DataFrame, most: int = 10, least_evidence: int = 1) -> DataFrame:
    """(query, disease, display, position, evidence, from_ner, rank): conditions by their best place.

    ranked: (query, position from 0, chunk_id, title, url, heading, ner). Each chunk counts for one condition."""
    best = best_problem("ner")
    named = ranked.select("query", "position", "chunk_id", best.alias("_b"), orphan_name("title", "url", "heading").alias("_o"))
    named = named.select("query", "position", "chunk_id", F.coalesce("_b.text", "_o").alias("display"), F.coalesce(F.col("_b.name"), ranking_name("_o")).alias("disease"), F.col("_b").isNotNull().alias("from_ner")).where("disease <> ''")
    groups = named.groupBy("query", "disease").agg(F.min(F.struct("position", "display")).alias("_f"), F.count("*").alias("evidence"), F.bool_or("from_ner").alias("from_ner")).where(F.col("evidence") >= least_evidence)
    out = groups.select("query", "disease", F.col("_f.display").alias("display"), F.col("_f.position").alias("position"), "evidence", "from_ner")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("position", "disease"))).where(F.col("rank") <= most)
