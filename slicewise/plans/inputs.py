"""Domain inputs derived from the test tables (the mappings the oracle SQL repeats)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import text as T
from slicewise.session import table
from slicewise.sources.files import pack_files

AS_OF = dt.date(2024, 1, 31)
TRIAGE_AS_OF = dt.date(2001, 12, 31)
TRIAGE_DAYS = 2000

# (a, b) per class of the score mapping below.
MIX = {"epidural": (7, 3), "intraparenchymal": (11, 5), "intraventricular": (13, 7),
       "subarachnoid": (17, 11), "subdural": (19, 13), "any": (23, 17)}

SLICE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")

SEGMENT_PHRASES = {
    "BUILDING": "Fall, altered mental status",
    "AUTOMOBILE": "Head trauma, loss of consciousness",
    "MACHINERY": "Sudden onset headache, hypertension",
    "FURNITURE": "Decreased level of consciousness",
    "HOUSEHOLD": "Thunderclap headache, worst of life",
}


def results_of(events: DataFrame) -> DataFrame:
    """Study results <- events."""
    raw = (F.when(F.col("event_type") == "click", "Emergency Dept 2")
           .when(F.col("event_type") == "view", "Neuro ICU")
           .when(F.col("event_type") == "purchase", "Medical Ward")
           .when(F.col("event_type") == "signup", "")
           .when(F.col("event_type") == "error", "o'neil annex 3rd"))
    rows = events.select(
        F.col("event_id").cast("string").alias("study_uid"), F.col("user_id").cast("string").alias("patient_id"),
        F.to_date("ts").alias("exam_date"), raw.alias("raw_department"),
        (F.col("value") >= 100).cast("int").alias("ai_positive"), (F.col("value") / F.lit(500.0)).alias("prob_any"))
    return T.with_location(rows)


def results(spark: SparkSession, sf: str) -> DataFrame:
    return results_of(table(spark, sf, "events"))


def _u(c: str) -> Column:
    a, b = MIX[c]
    return ((F.col("l_partkey") * a + F.col("l_suppkey") * b + F.col("l_linenumber") * 29) % 1000) / F.lit(1000.0)


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Scored, labelled slices <- lineitem."""
    noise = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000) / F.lit(1000.0)
    base = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("study_uid"), F.col("l_quantity").alias("z_mm"), *SLICE_ORDER,
        noise.alias("noise"), *[_u(c).alias(f"u_{c}") for c in K.CLASSES])
    u = {c: F.col(f"u_{c}") for c in K.CLASSES}
    return base.select(
        "study_uid", "z_mm", *SLICE_ORDER,
        *[(u[c] * u[c] * u[c]).alias(f"p_{c}") for c in K.CLASSES],
        *[((u[c] - 0.5) * 8).alias(f"x_{c}") for c in K.CLASSES],
        *[(u[c] + F.col("noise") > F.lit(1.5)).cast("int").alias(f"y_{c}") for c in K.CLASSES])


def labels_long(spark: SparkSession, sf: str) -> DataFrame:
    """Long labels <- labels; quality 0 repeats its subdural label with the other value."""
    q, t = F.col("quality"), F.col("toxic")
    def row(cls: str, label: Column, ord_: int, keep: Column) -> Column:
        return F.struct(F.lit(cls).alias("c"), label.alias("l"), F.lit(ord_).alias("o"), keep.alias("k"))

    rows = F.array(row("epidural", q * t, 0, F.lit(True)), row("subdural", t, 0, F.lit(True)),
                   row("subarachnoid", 1 - q, 0, F.lit(True)), row("any", F.greatest(t, 1 - q), 0, F.lit(True)),
                   row("subdural", 1 - t, 1, q == 0))
    return (table(spark, sf, "labels").select("doc_id", F.explode(rows).alias("r")).filter("r.k")
            .select(F.concat(F.lit("ID_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("r.c")).alias("ID"),
                    F.col("r.l").alias("Label"), F.col("r.o").alias("ord")))


def headers(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    return headers_of(table(spark, sf, "lineitem"), table(spark, sf, "part"), together=together)


def scan_headers(spark: SparkSession, sf: str) -> DataFrame:
    """File headers with patient, study time and department <- lineitem join part, each study in one partition."""
    return headers_of(table(spark, sf, "lineitem"), table(spark, sf, "part"), scan=True, together=True)


def _series_files(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem join part, by series: keys travel, what is made of them is made where it is needed."""
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    li = table(spark, sf, "lineitem").select("l_orderkey", *SLICE_ORDER)
    study = F.col("l_orderkey").cast("string")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return rows.withColumns({"study_uid": study, "series_uid": F.concat(study, F.lit("."), F.col("p_type"))}).repartition("study_uid", "series_uid")


def scan_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices with the scores of :func:`slices` and the series they belong to <- lineitem join part."""
    u = {c: _u(c) for c in K.CLASSES}
    return _series_files(spark, sf).select("study_uid", "series_uid", *SLICE_ORDER, *[(u[c] * u[c] * u[c]).alias(f"p_{c}") for c in K.CLASSES])


def scan_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Small pixel blocks of the series they belong to <- lineitem join part; the fixture scorer takes them to the scores of ``slices``."""
    return _series_files(spark, sf).select("study_uid", "series_uid", file_path().alias("path"),
                                           F.array(*[_u(c) for c in K.CLASSES]).alias("block"), "l_partkey", "l_suppkey", "l_linenumber")


def image_files(spark: SparkSession, sf: str, folder: str) -> int:
    """Packs one small image file an order: customers are studies, priorities series, every 29th file is broken.

    A file is a JSON header, a zero byte and 5,000 bytes that stand for pixels.
    """
    size = F.col("o_orderkey") % 40
    desc = (F.when(size % 4 == 0, "AXIAL HEAD W/O").when(size % 4 == 1, "Brain noncontrast thin").when(size % 4 == 2, "CTA HEAD").otherwise(""))
    head = F.struct(
        F.col("o_custkey").cast("string").alias("study_uid"), series_of().alias("series_uid"), F.when(size == 7, "MR").otherwise("CT").alias("modality"),
        desc.alias("series_description"), F.when(F.col("o_custkey") % 9 == 0, "CT CHEST").otherwise("").alias("study_description"),
        size.cast("string").alias("slice_thickness"), F.array(F.when(size % 11 == 0, "DERIVED").otherwise("ORIGINAL")).alias("image_type"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"))
    body = F.when(F.col("o_orderkey") % 29 == 0, "no header here").otherwise(F.to_json(head))
    name = F.concat(F.col("o_custkey").cast("string"), F.lit("/"), series_of(), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".dcm"))
    rows = table(spark, sf, "orders").select("o_custkey", name.alias("name"), body.alias("body"))
    placed = rows.repartition("o_custkey").sortWithinPartitions("o_custkey", "name")
    return pack_files(placed, folder, lambda body: body.encode() + b"\0" + b"p" * 5000)


def known_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Studies of :func:`image_files` that are in the store already."""
    return table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("study_uid"))


def series_of() -> Column:
    return F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1))


def json_head(data: bytes) -> dict | None:
    """Decoder of :func:`image_files`."""
    import json
    head, end, _ = data.partition(b"\0")
    return json.loads(head) if end else None


def cubic_scorer():
    """Fixture scorer: cubes of the block's values; refuses values out of range as a real one refuses a broken block."""
    def predict(block):
        if (block < 0).any():
            raise ValueError("block out of range")
        return block * block * block
    return predict


def file_path() -> Column:
    s = {c: F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}
    return F.concat(s["l_orderkey"], F.lit("/"), F.col("p_type"), F.lit("/"), s["l_linenumber"], F.lit("_"),
                    s["l_partkey"], F.lit("_"), s["l_suppkey"], F.lit(".dcm"))


def headers_of(lineitem: DataFrame, part: DataFrame, scan: bool = False, together: bool = False) -> DataFrame:
    """File headers <- lineitem join part.

    ``together`` gathers the files of a study, as a folder's listing does, while the rows are
    still numbers: what rolls them up then moves no header text.
    """
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    part = part.select("p_partkey", "p_type", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey").withColumn("study_uid", F.col("l_orderkey").cast("string"))
    if together:
        j = j.repartition("study_uid")
    size = F.col("p_size").cast("string")
    desc = (F.when(F.col("p_type") == "SMALL", "AXIAL HEAD W/O").when(F.col("p_type") == "LARGE", "CTA HEAD")
            .when(F.col("p_type") == "PROMO", "Brain noncontrast thin").when(F.col("p_type") == "STANDARD", "BONE RECON")
            .when(F.col("p_type") == "ECONOMY", "").otherwise("CHEST"))
    day = F.date_format("l_shipdate", "yyyyMMdd")
    seen = [F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("patient_id"),
            F.concat(F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0"), F.when(F.col("l_linenumber") == 3, "").otherwise("3015.5"))
            .alias("study_time"),
            F.when(F.col("p_size") % 4 == 0, "Emergency Dept 2").when(F.col("p_size") % 4 == 1, "Neuro ICU")
            .when(F.col("p_size") % 4 == 2, "o'neil annex 3rd").otherwise("").alias("institutional_department")]
    return j.select(
        *(seen if scan else []),
        "study_uid", F.concat("study_uid", F.lit("."), F.col("p_type")).alias("series_uid"),
        file_path().alias("path"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), "MR").otherwise("CT").alias("modality"),
        desc.alias("series_description"), desc.alias("study_description"),
        F.when(F.col("p_size") % 9 == 0, "x").otherwise(size).alias("slice_thickness"),
        F.when(F.col("p_size") % 7 == 0, "OMNIPAQUE").when(F.col("p_size") % 5 == 0, "None").otherwise("")
        .alias("contrast_bolus_agent"),
        F.array(F.when(F.col("p_size") % 11 == 0, "DERIVED").otherwise("ORIGINAL")).alias("image_type"),
        F.when(F.col("l_linenumber") == 5, F.substring(day, 1, 4)).otherwise(day).alias("study_date"),
        F.lit(None).cast("string").alias("error"))


def processed(spark: SparkSession, sf: str) -> DataFrame:
    """Studies already in the store <- finished orders."""
    return (table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
            .select(F.col("o_orderkey").cast("string").alias("study_uid")))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reader votes <- orders."""
    codes = ["SDH", "EDH", "IPH", "IVH", "SAH", "ICH"]
    votes = []
    for i, code in enumerate(codes):
        for j, reader in enumerate(K.READERS):
            mark = (F.col("o_custkey") * (i + 3) + F.col("o_orderkey") * (j + 2)) % (11 + 4 * i) < 4
            votes.append(F.when(mark, "1").otherwise("0" if j else "").alias(f"{reader}:{code}"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("CASE-CT-"), F.col("o_orderkey").cast("string")).alias("name"), *votes)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 pixel blocks in HU <- embeddings."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("ID_"), F.col("vec_id").cast("string")).alias("image_id"), "label",
        F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(16).alias("bits_allocated"),
        F.transform("embedding", lambda v: v.cast("double") * F.lit(400.0)).alias("hu"))


def raw_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pixel blocks with four tag layouts, by label."""
    four = F.col("label") % 4
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("ID_"), F.col("vec_id").cast("string")).alias("image_id"),
        F.transform("embedding", lambda v: v.cast("double") * F.lit(400.0)).alias("pixels"),
        F.when(four == 1, "float32").when(four == 2, "uint16").otherwise("int16").alias("pixel_type"),
        F.when(four == 0, F.lit(2.0)).alias("rescale_slope"),
        F.when(four == 3, F.lit(-1024.0)).alias("rescale_intercept"))


def worklist(spark: SparkSession, sf: str) -> DataFrame:
    return worklist_of(table(spark, sf, "orders"), table(spark, sf, "customer"))


def worklist_of(o: DataFrame, c: DataFrame) -> DataFrame:
    """Worklist entries <- orders join customer."""
    j = o.join(c, o.o_custkey == c.c_custkey)
    phrase = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in SEGMENT_PHRASES.items()])
    positive = F.col("o_orderpriority") == "2-HIGH"
    return j.select(
        F.col("o_orderkey").cast("string").alias("study_uid"), F.col("c_name").alias("patient_id"),
        F.lit("").alias("patient_name"), phrase.alias("indication"),
        (F.col("o_orderpriority") == "1-URGENT").alias("physician_stat"), positive.alias("ai_positive"),
        F.when(positive & (F.col("o_orderstatus") != "P"), "subdural hematoma").otherwise("").alias("dominant_class"),
        (F.col("o_totalprice") % 1000 / F.lit(1000.0)).alias("prob_any"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("exam_time"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Token ledger <- conversations."""
    n = F.length("text")
    answer = F.col("role") == "assistant"
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("study_id"), F.col("role").alias("stage"),
        F.when(~answer, n).alias("input_tokens"), F.when(answer, n).alias("output_tokens"),
        F.when(F.col("turn") == 0, 10).otherwise(0).alias("cache_creation_input_tokens"),
        F.when(F.col("turn") > 0, F.col("turn")).alias("cache_read_input_tokens"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Training histories <- orders: one run per customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"),
        ((F.col("o_orderkey") * 7 % 19 + 80) / F.lit(100.0)).alias("mean_auc"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """File paths of several naming styles <- lineitem."""
    part, ln = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    supp = F.col("l_suppkey").cast("string")
    path = (F.when(ln == 1, F.concat(F.lit("a.b/ID_"), part, F.lit(".dcm")))
            .when(ln == 2, F.concat(F.lit("in/1.2.840."), part, F.lit(".dcm")))
            .when(ln == 3, F.concat(F.lit("x/y/ct-"), supp, F.lit("-"), part, F.lit(".DCM")))
            .when(ln == 4, F.concat(F.lit("scan "), part, F.lit("(x).dcm")))
            .when(ln == 5, F.concat(F.lit("d/x.y_"), part, F.lit(".z!.dcm")))
            .otherwise(F.concat(F.lit("d/im_"), part, F.lit("_"), supp)))
    return table(spark, sf, "lineitem").select(path.alias("path"))


def geometry_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slice origins and spacing <- lineitem; some series lack an orientation."""
    d = lambda c: F.col(c).cast("double")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("study_uid"), *SLICE_ORDER,
        F.col("l_linenumber").alias("instance_number"),
        F.array(d("l_partkey") * 0.5, d("l_suppkey") * 0.25, d("l_quantity")).alias("image_position"),
        F.when(F.col("l_returnflag") != "N", F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, -1.0, 0.0, 0.0)]))
        .alias("image_orientation"),
        F.array(F.lit(0.5), d("l_linenumber") * 0.25).alias("pixel_spacing"),
        F.when(F.col("l_linestatus") == "F", F.lit(2.5)).alias("slice_thickness"))


def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text reports with marked sections <- conversations."""
    n = F.col("turn") % 4
    body, bullet = F.lit(" report body paragraph: "), F.lit("\nImpression Bullet Point:\n")
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")).alias("study_uid"),
        F.when(n == 0, F.concat(F.lit("x"), body, text, bullet, F.col("role"), F.lit(" ")))
        .when(n == 1, F.concat(body, text)).when(n == 2, F.concat(text, bullet, F.col("role"), body, F.lit("late")))
        .otherwise(text).alias("report"))
