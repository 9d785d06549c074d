"""Labelled synthetic prompts: templates filled with entity values, their redacted form, and reports on them.

Values follow from the row's number and the entity's place by whole-number arithmetic, so that a rerun, or another
engine, gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.templates import ALPHABET, DATES, DIGITS, FIRST, FORMATS, LETTERS, MONTHS, SECOND
from veilspark.operators.templates import rows as numbered

# Entity types by severity.
SEVERITY = {
    "CRITICAL": ["IBAN", "ACCOUNT_NUMBER", "CREDIT_CARD", "DEBIT_CARD", "BIC_SWIFT", "ROUTING_NUMBER", "SORT_CODE", "TAX_ID", "SSN"],
    "HIGH": [
        "AMOUNT", "TRANSACTION_ID", "PAYMENT_REF", "WIRE_REF", "SEPA_REF", "MANDATE_ID", "LOAN_ID", "MORTGAGE_ID", "CREDIT_LIMIT", "CREDIT_SCORE", "LOAN_BALANCE", "PERSON",
        "CUSTOMER_ID", "PASSPORT", "DRIVING_LICENSE", "NATIONAL_ID", "SALARY", "INCOME", "POLICY_NUMBER", "CLAIM_ID", "PORTFOLIO_ID", "INVESTMENT_AMOUNT", "VAT_NUMBER",
        "API_KEY", "TOKEN", "FATCA_ID", "CRS_ID", "AML_CASE", "SAR_ID", "DATE_OF_BIRTH",
    ],
    "MEDIUM": ["INTEREST_RATE", "EMAIL", "PHONE_NUMBER", "ADDRESS", "POSTAL_CODE", "EMPLOYER", "OCCUPATION", "PREMIUM", "ISIN", "COMPANY_REG", "DUNS_NUMBER", "LEI_CODE", "IP_ADDRESS", "MAC_ADDRESS", "EXPIRY_DATE", "FILE_PATH"],
    "LOW": ["TICKER", "SESSION_ID", "DATE", "DOCUMENT_REF", "URL"],
}
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
# Entity types of the first generator.
FIRST_TYPES = ["PERSON", "AMOUNT", "IBAN", "CUSTOMER_ID", "PHONE_NUMBER", "EMAIL", "YEAR", "URL", "CORP_KEY", "DOCUMENT_REF", "APP_ID", "TRANSFER_ID"]
# Entity types of seeded detections.
SEED_TYPES = ["YEAR", "URL", "PERSON", "AMOUNT", "PHONE_NUMBER", "EMAIL", "IBAN", "CUSTOMER_ID"]
# Roles of the five sample users.
SEED_ROLES = ["analyst", "manager", "compliance", "admin", "analyst"]
# Types that make a prompt of the first generator sensitive.
HIGH_TYPES = ["IBAN", "AMOUNT", "CUSTOMER_ID", "TRANSFER_ID"]
MEDIUM_TYPES = ["PERSON", "EMAIL", "PHONE_NUMBER", "CORP_KEY"]

def catalogue(spark: SparkSession) -> DataFrame:
    """entity_type, sensitivity and rank of all types of the second generator."""
    return spark.createDataFrame([(t, s, RANK[s]) for s, types in SEVERITY.items() for t in types], "entity_type string, sensitivity string, rank int")


def first_catalogue(spark: SparkSession) -> DataFrame:
    """entity_type and sensitivity of the types of the first generator."""
    level = lambda t: "HIGH" if t in HIGH_TYPES else "MEDIUM" if t in MEDIUM_TYPES else "LOW"
    return spark.createDataFrame([(t, level(t)) for t in FIRST_TYPES], "entity_type string, sensitivity string")


def templates(spark: SparkSession, source: dict[str, list[str]] = SECOND) -> DataFrame:
    """template_id, category and template; any other table of these columns will do as well, of any size."""
    return spark.createDataFrame(numbered(source), "template_id long, category string, template string")


def value_of(kind: Column, row: Column, place: Column) -> Column:
    """A value in its type's format, from the row's number and the place in the template.

    The format's signs are replaced by the digits of one number, and by letters that these digits pick."""
    n = (row * 7919 + place * 104_729 + 12_345).cast("long")
    digits = F.lpad((n % 1_000_000_007 * 998_244_353 % 10**12).cast("string"), 12, "0")
    known = F.create_map(*[x for t, masks in FORMATS.items() for x in (F.lit(t), F.array(*map(F.lit, masks)))])
    masks = F.coalesce(F.try_element_at(known, kind), F.array(F.concat(F.lower(kind), F.lit("-" + DIGITS[:6]))))
    spelled = F.call_function("translate", F.get(masks, (n % F.size(masks)).cast("int")), F.lit(DIGITS + LETTERS), F.concat(digits, F.translate(digits, "0123456789", ALPHABET)))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.concat((1950 + n % 60).cast("string"), F.lit("-"), two(1 + n % 12), F.lit("-"), two(1 + n % 28))
    month = F.concat(two(1 + n % 12), F.lit("/"), two(26 + n % 5))
    return F.when(kind.isin(*DATES), date).when(kind.isin(*MONTHS), month).otherwise(spelled)


def fill(df: DataFrame, row: str = "id", template: str = "template", indexed: bool = True, known: list[str] | None = None) -> DataFrame:
    """``df`` with original_text, redacted_text and entity_mappings (entity_type, original, placeholder, confidence), entity by entity in order.

    ``indexed``: the second of a type is <TYPE_2>, and so on; else all are <TYPE>. Types that aren't in ``known`` stay as
    they are. One expression for each row, no shuffle."""
    known = [t for types in SEVERITY.values() for t in types] if known is None else known
    parts, names = F.split(F.col(template), r"\{[^}]+\}", -1), F.col("veil_names_")
    df = df.withColumn("veil_names_", F.regexp_extract_all(F.col(template), F.lit(r"\{([^}]+)\}"), F.lit(1)))
    known = F.array(*map(F.lit, known)).cast("array<string>")
    marks = F.transform(names, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.size(F.filter(F.slice(names, 1, i + 1), lambda x: x == t)).alias("k"), F.array_contains(known, t).alias("known")))

    def mapping(m: Column) -> Column:
        again = F.concat(m["t"], F.lit("_"), m["k"].cast("string")) if indexed else m["t"]
        name = F.when(m["k"] > 1, again).otherwise(m["t"])
        raw = F.concat(F.lit("{"), m["t"], F.lit("}"))
        return F.struct(m["t"].alias("entity_type"), F.when(m["known"], value_of(m["t"], F.col(row), m["i"])).otherwise(raw).alias("original"), F.when(m["known"], F.concat(F.lit("<"), name, F.lit(">"))).otherwise(raw).alias("placeholder"), m["known"].alias("known"), confidence(F.col(row), m["i"]).alias("confidence"))

    out = df.withColumn("veil_parts_", parts).withColumn("veil_maps_", F.transform(marks, mapping))

    def joined(field: str) -> Column:
        gaps = F.zip_with(F.slice("veil_parts_", 2, F.size("veil_parts_")), F.transform("veil_maps_", lambda m: m[field]), lambda a, v: F.concat(v, a))
        return F.concat(F.col("veil_parts_")[0], F.array_join(gaps, ""))

    kept = F.transform(F.filter("veil_maps_", lambda m: m["known"]), lambda m: F.struct(m["entity_type"], m["original"], m["placeholder"], m["confidence"]))
    return out.withColumns({"original_text": joined("original"), "redacted_text": joined("placeholder"), "entity_mappings": kept}).drop("veil_names_", "veil_parts_", "veil_maps_")


def confidence(row: Column, place: Column) -> Column:
    """Between 0.85 and 0.99, by thousandths."""
    return F.round(0.85 + ((row * 31 + place * 17) % 141) / 1000.0, 3)


def generate(spark: SparkSession, n: int, indexed: bool = True, source: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """``n`` rows: id, category, template, both texts, the mappings, and both kinds of sensitivity. The template is the row's number's.

    ``source``: templates by category, or a table as templates() gives; the first generator's if ``indexed``, else the
    second's. A table beyond Spark's broadcast limit is joined by a shuffle."""
    table = source if isinstance(source, DataFrame) else templates(spark, source or (FIRST if indexed else SECOND))
    rows = spark.range(n).withColumn("template_id", F.col("id") % table.count())
    out = fill(rows.join(table, "template_id"), indexed=indexed, known=FIRST_TYPES if indexed and source is None else None)
    types = F.transform("entity_mappings", lambda m: m["entity_type"])
    return out.withColumns({"sensitivity_level": sensitivity_max(types), "sensitivity_group": sensitivity_overlap(types)}).drop("template_id")


def sensitivity_max(types: Column) -> Column:
    """The highest severity of the types; LOW without any."""
    out = F.lit("LOW")
    for level in ("MEDIUM", "HIGH", "CRITICAL"):
        out = F.when(F.arrays_overlap(types, F.array(*map(F.lit, SEVERITY[level]))), level).otherwise(out)
    return out


def sensitivity_overlap(types: Column) -> Column:
    hit = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return F.when(hit(HIGH_TYPES), "HIGH").when(hit(MEDIUM_TYPES), "MEDIUM").otherwise("LOW")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Value, n and percent; the total is a window over the few groups."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def level_distribution(df: DataFrame, column: str = "sensitivity_level") -> DataFrame:
    """All four levels, with zeros."""
    levels = df.sparkSession.createDataFrame([(x, r) for x, r in RANK.items()], "level string, rank int")
    n = df.groupBy(F.col(column).alias("l_")).agg(F.count("*").alias("n"))
    out = levels.join(n, levels.level == n.l_, "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("percent", F.col("n") * 100.0 / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)))


def top_entities(df: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent entity types; ties by name."""
    types = df.select(F.explode("entity_mappings").alias("m")).select("m.entity_type")
    return types.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(k)


def seed_workflow(rows: DataFrame, row: str = "id") -> DataFrame:
    """Interactions of a session for each row: a redaction; in 70 % a prediction; in 30 %, if the user is an admin, a restoring.

    What is random elsewhere follows from the row's number here: session_id, user_id, role, action, step."""
    n = F.col(row).cast("long")
    user = (n * 7919) % len(SEED_ROLES)
    role = F.element_at(F.array(*map(F.lit, SEED_ROLES)), (user + 1).cast("int"))
    steps = F.array_compact(F.array(
        F.lit("text_redacted"), F.when((n * 104_729) % 10 < 7, "prediction_generated"), F.when(((n * 1_299_709 + 3) % 10 < 3) & (role == "admin"), "text_de_scrubbed"),
    ))
    sessions = rows.select(F.concat(F.lit("seed-"), n.cast("string")).alias("session_id"), F.concat(F.lit("user_00"), (user + 1).cast("string")).alias("user_id"), role.alias("user_role"), F.posexplode(steps).alias("step", "action"))
    return sessions.select("session_id", "user_id", "user_role", "action", F.col("step").cast("long").alias("step"))


def seed_detections(row: Column) -> Column:
    """array<struct<entity_type,original,placeholder>>: two to five, the first as <T>, the later ones as <T_i>."""
    kinds = F.array(*map(F.lit, SEED_TYPES))

    def one(i: Column) -> Column:
        kind = F.element_at(kinds, ((row * 31 + i * 17) % len(SEED_TYPES) + 1).cast("int"))
        name = F.when(i > 0, F.concat(kind, F.lit("_"), (i + 1).cast("string"))).otherwise(kind)
        return F.struct(kind.alias("entity_type"), value_of(kind, row, i).alias("original"), F.concat(F.lit("<"), name, F.lit(">")).alias("placeholder"))

    return F.transform(F.sequence(F.lit(0), (row % 4 + 1).cast("int")), one)
