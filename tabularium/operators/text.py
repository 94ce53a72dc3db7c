"""Keywords, and personal data: found, reported and masked."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabularium.operators.common import rows_from, text_columns
from tabularium.operators.quality import normal_name

#: Words that say nothing of a text.
STOP_WORDS = (
    "the and a an is was were are to of in for on with this that it as at by from be or but not have has had i you he she we they his her its our their them my your so if "
    "then than there here what which who when where how all some no yes do does did can could will would should just also very too up out about into over after before again one two"
).split()


#: Words that the sketch of a task keeps, words it names, and how far, as a share of all words, its counts may be too high (3.5 over its table's size, of which three quarters are used).
TRACKED, NAMED = 16_384, 300
EXCESS = 3.5 * 0.75


def keywords(df: DataFrame, col: str, n: int = 15, least: int = 10) -> DataFrame:
    """(word, n, entries_pct): runs of three or more ASCII letters in lower case, stop words aside; the n most frequent, ties by word.

    Needs `least` non-blank entries of two words or more on average. Heavy-hitter sketches, one a task, name the words that may be among the n most frequent; a second scan counts only these exactly.
    The sketches' error bounds what any other word may count: where the n-th exact count does not exceed it, all words are counted.
    """
    texts = df.select(F.col(col).alias("t")).where("trim(t) <> ''")
    words = F.filter(F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{3,}"), 0), lambda w: ~w.isin(STOP_WORDS))
    size = F.size(F.filter(F.split(F.trim("t"), r"\s+"), lambda w: w != ""))
    each = texts.select(size.alias("size"), words.alias("w")).select("size", F.posexplode_outer("w").alias("at", "word"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0  # one row of each entry
    row = each.agg(F.count_if(first).alias("entries"), F.avg(F.when(first, F.col("size"))).alias("words"), F.count("word").alias("total"), F.expr(f"approx_top_k(word, {NAMED}, {TRACKED})").alias("named")).first()
    if row["entries"] < least or row["words"] < 2:
        return df.sparkSession.createDataFrame([], "word string, n long, entries_pct double")
    excess = EXCESS / TRACKED * row["total"]
    named = {r["item"]: r["count"] for r in row["named"] if r["item"] is not None}
    estimates = sorted(named.values(), reverse=True)
    likely = [w for w, k in named.items() if k >= estimates[min(n, len(estimates)) - 1] - excess]
    counted = _word_counts(texts, F.filter(words, lambda w: w.isin(likely))).collect() if likely else []  # at most NAMED rows
    # what a word that is not named may count
    ceiling = max(2 * excess, estimates[-1] if len(row["named"]) == NAMED else 0)
    best = sorted(counted, key=lambda r: (-r["n"], r["word"]))[:n]
    if (best[n - 1]["n"] if len(best) == n else 1) > ceiling:
        return df.sparkSession.createDataFrame([(r["word"], r["n"], r["e"] * 100.0 / row["entries"]) for r in best], "word string, n long, entries_pct double")
    by = _word_counts(texts, words)
    return by.select("word", "n", (F.col("e") * 100.0 / F.lit(row["entries"])).alias("entries_pct")).orderBy(F.desc("n"), "word").limit(n)


def _word_counts(texts: DataFrame, words: Column) -> DataFrame:
    """(word, n, e): occurrences and entries. An entry sends its words, and once more the different ones, so that one grouping, combined before the shuffle, counts both."""
    once = lambda w, n, e: F.struct(w.alias("word"), F.lit(n).alias("n"), F.lit(e).alias("e"))
    each = texts.select(words.alias("w")).select(F.explode(F.concat(F.transform("w", lambda w: once(w, 1, 0)), F.transform(F.array_distinct("w"), lambda w: once(w, 0, 1)))).alias("x")).select("x.*")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


#: What e-mail addresses, government numbers, IP addresses, phone and card numbers look like. All runs are bounded.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
AADHAAR = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
IPV4 = r"((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PHONE = r"\+?\(?[0-9]{1,4}\)?[ \t.\-]?\(?[0-9]{2,5}\)?[ \t.\-]?[0-9]{3,5}[ \t.\-]?[0-9]{0,5}"
DATE_LIKE = r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}.{0,200}"
NAME = r"[A-Z][a-z'\-]{1,60}([ \t]{1,8}[A-Z][a-z'\-.]{1,60}){1,2}"
#: What headers of personal data are called, words that make a header one about such a field, and what makes an id a person's.
HEADERS = {
    "email": ("email", "e mail", "emailaddress", "mail address"),
    "phone": ("phone", "mobile", "telephone", "cellphone", "contact number", "whatsapp"),
    "gov_id": ("ssn", "social security", "aadhaar", "aadhar", "passport", "tax id", "pan number", "driver license", "drivers license", "licence number", "license number"),
    "card": ("credit card", "card number", "cardnumber", "debit card", "iban", "account number", "bank account", "cvv", "routing number"),
    "dob": ("dob", "birth date", "birthdate", "date of birth", "birthday"),
    "address": ("street", "address", "street address", "home address", "postcode", "postal code", "zip code", "zipcode"),
    "ip": ("ip address", "ipaddress"),
    "person_name": ("first name", "last name", "full name", "surname", "given name", "firstname", "lastname", "fullname", "forename", "customer name", "patient name", "employee name", "student name", "contact name", "client name", "member name", "user name", "username"),
}
ABOUT = ("model", "type", "count", "status", "flag", "domain", "provider", "brand", "plan", "usage", "year")
PERSONS = "customer patient user employee member student person client passenger subscriber visitor account staff worker applicant donor resident policyholder cardholder driver".split()
IDS = ("id", "ids", "no", "number", "code", "key", "uid", "guid", "uuid")
#: Words of headers whose names are no person's; kinds whose values are telling by themselves; kinds whose headers nearly always mean a person.
NOT_PERSONS = ("product", "item", "company", "brand", "city", "country", "state", "category", "region", "store", "file", "campaign", "project", "team", "department", "school", "hospital")
STRONG = ("email", "gov_id", "card")
PERSONAL = ("email", "phone", "gov_id", "card", "person_id", "dob", "person_name")
#: The order in which values of equal rates are judged.
ORDER = ("email", "gov_id", "card", "ip", "phone", "person_name")


def _whole(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(f"^(?:{pattern})$"))


def _card(c: Column) -> Column:
    digits = F.regexp_replace(c, "[ -]", "")
    return F.rlike(c, F.lit(r"^[0-9][0-9 \-]{11,25}[0-9]$")) & F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.rlike(digits, F.lit("^[0-9]{13,19}$")), digits)), F.lit(False))


def _matchers(c: Column) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return {
        "email": F.contains(c, F.lit("@")) & _whole(c, EMAIL),
        "gov_id": _whole(c, SSN) | _whole(c, PAN) | _whole(c, AADHAAR),
        "card": _card(c),
        "ip": _whole(c, IPV4),
        "phone": _whole(c, PHONE) & digits.between(7, 15) & ~_whole(c, DATE_LIKE),
        "person_name": _whole(c, NAME),
    }


def header_words(name: str) -> list[str]:
    """A header's words in lower case; capitals begin one."""
    return normal_name(re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)).split()


def header_kind(name: str) -> str | None:
    """What a header alone says; headers about a field (`email_count`, `address type`) don't count."""
    words = header_words(name)
    if not words or words[-1] in ABOUT:
        return None
    line = f" {' '.join(words)} "
    found = next((kind for kind, names in HEADERS.items() for h in names if f" {h} " in line), None)
    person = any(w in PERSONS for w in words)
    return found or ("person_id" if person and (words[-1] in IDS or "id" in words) else None)


def value_rates(df: DataFrame) -> DataFrame:
    """(column, kind, rate, distinct_share) of all non-blank values of all text columns, by one pass."""
    cols = text_columns(df)
    aggs, names = [], {}
    for c in cols:
        v = F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")))
        for kind, match in _matchers(v).items():
            aggs.append(F.avg(F.when(v.isNotNull(), match.cast("int"))).alias(f"{c}|{kind}"))
            names[f"{c}|{kind}"] = {"rate": f"{c}|{kind}", "distinct_share": f"{c}|d"}
        aggs.append(F.try_divide(F.approx_count_distinct(v), F.count(v)).alias(f"{c}|d"))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, kind string, rate double, distinct_share double")
    rows = rows_from(df.agg(*aggs), names, "key")
    return rows.select(F.expr("substring_index(key, '|', 1)").alias("column"), F.expr("substring_index(key, '|', -1)").alias("kind"), "rate", "distinct_share")


def scan_sensitive(df: DataFrame) -> DataFrame:
    """(column, kind, by_value, by_header, rate, confidence) of columns that seem to hold personal data; never a value.

    By value: a pattern matches half of the non-blank text; the best rate wins. Phone and government numbers look alike, so there the header decides.
    Person names need a rate of 0.6, 40 % distinct values and a header that is about a name or says nothing else. By header: any column.
    confidence: high where both agree on the kind, or by value alone for an e-mail address, a government or card number at a rate of 0.8; medium by another value, or by a header that
    is almost always personal; low by other headers. A column without any text (or numbers) has no e-mail addresses, phones or cards to show.
    """
    kinds = {c: header_kind(c) for c in df.columns}
    named = [c for c in df.columns if kinds[c] == "person_name" or (kinds[c] is None and "name" in header_words(c) and not set(header_words(c)) & set(NOT_PERSONS))]
    heads = df.sparkSession.createDataFrame([(c, k) for c, k in kinds.items() if k], "column string, header_kind string")
    person = (F.col("kind") == "person_name") & (F.col("rate") >= 0.6) & (F.col("distinct_share") >= 0.4) & F.col("column").isin(named or [""])
    good = person | ((F.col("kind") != "person_name") & (F.col("rate") >= 0.5))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    # person names only where nothing else matches
    best = Window.partitionBy("column").orderBy(F.col("kind") == "person_name", F.desc("rate"), rank)
    values = value_rates(df)
    blank = values.groupBy("column").agg(F.max("rate").isNull().alias("blank"))
    values = values.where(good).withColumn("k", F.row_number().over(best)).where("k = 1").select("column", F.col("kind").alias("value_kind"), "rate")
    both = values.join(heads, "column", "full_outer").join(blank, "column", "left")
    alike = F.col("value_kind").isin("phone", "gov_id") & F.col("header_kind").isin("phone", "gov_id")
    both = both.withColumn("value_kind", F.when(alike, F.col("header_kind")).otherwise(F.col("value_kind")))
    by_value, by_header = F.col("value_kind").isNotNull(), F.col("header_kind").isNotNull()
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    empty = ~by_value & F.col("header_kind").isin("email", "phone", "card") & F.coalesce("blank", ~F.col("column").isin(numbers or [""]))
    confidence = F.when(by_value & (F.col("value_kind") == F.col("header_kind")), "high").when(by_value, F.when(F.col("value_kind").isin(*STRONG) & (F.col("rate") >= 0.8), "high").otherwise("medium"))
    confidence = confidence.otherwise(F.when(F.col("header_kind").isin(*PERSONAL), "medium").otherwise("low"))
    return both.where(~F.coalesce(empty, F.lit(False))).select("column", F.coalesce("value_kind", "header_kind").alias("kind"), by_value.alias("by_value"), by_header.alias("by_header"), "rate", confidence.alias("confidence"))


def scan_text_leaks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, kind, rows): rows with an e-mail address, a social security number not inside longer digits, or a whole card number."""
    aggs, names = [], {}
    for c in cols:
        v = F.col(f"`{c}`").cast("string")
        for kind, hit in {"email": F.contains(v, F.lit("@")) & F.rlike(v, F.lit(EMAIL)), "ssn": F.rlike(v, F.lit(rf"(^|[^0-9-]){SSN}($|[^0-9-])")), "card": _card(F.trim(v))}.items():
            aggs.append(F.count_if(hit).alias(f"{c}|{kind}"))
            names[f"{c}|{kind}"] = {"rows": f"{c}|{kind}"}
    return rows_from(df.agg(*aggs), names, "key").select(F.expr("substring_index(key, '|', 1)").alias("column"), F.expr("substring_index(key, '|', -1)").alias("kind"), "rows")


def publish_findings(df: DataFrame, masked: list[str] | None = None) -> DataFrame:
    """(column, kind, source value | header | text, confidence, blocks): one finding for each column; values beat headers, headers beat text.

    A declared mask hides header findings alone. High and medium findings block.
    """
    scan = scan_sensitive(df).select("column", "kind", F.when(F.col("by_value"), "value").otherwise("header").alias("source"), "confidence")
    leaks = scan_text_leaks(df, text_columns(df)).where("rows > 0").select("column", "kind", F.lit("text").alias("source"), F.lit("medium").alias("confidence"))
    order = F.when(F.col("source") == "value", 0).when(F.col("source") == "text", 1).otherwise(2)
    rows = scan.unionByName(leaks).where(~((F.col("source") == "header") & F.col("column").isin(masked or [""])))
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(order, "kind"))).where("k = 1").drop("k")
    return one.withColumn("blocks", F.col("confidence").isin("high", "medium"))


def mask_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with a pseudonym `<column> <number>` for each value of the text columns (equal values, equal names) and without numeric ones.

    Numbers come from the order of the distinct values' hashes within ranges of hashes, so that no window spans all of them.
    """
    out = df
    for c in cols:
        if isinstance(df.schema[c].dataType, T.NumericType):
            out = out.drop(c)
            continue
        names = df.select(F.col(c).alias("__v")).where("__v is not null").distinct().withColumn("h", F.xxhash64("__v")).withColumn("r", F.shiftright("h", 58))
        totals = names.groupBy("r").agg(F.count(F.lit(1)).alias("t"))
        offsets = totals.select("r", F.coalesce(F.sum("t").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))  # 64 ranges
        numbered = names.join(F.broadcast(offsets), "r").select("__v", F.concat(F.lit(f"{c} "), (F.row_number().over(Window.partitionBy("r").orderBy("h", "__v")) + F.col("o")).cast("string")).alias("__m"))
        out = out.join(numbered, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__m")).drop("__v", "__m")
    return out
