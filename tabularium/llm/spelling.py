"""Spelling variants: words of a corpus one edit apart, grouped under the most frequent form.

An edit leaves one half of a word as it is. Words meet those that begin or end with that half in blocks of bounded size; in each, a bidirectional FM-index of the block's words matches the half
exactly and goes across the other half with one error. Blocks return a count and the best form for each word, so that no pairs are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import written
from tabularium.llm.fm_index import WordIndex
from tabularium.llm.groups import by_group

#: Index words that a bucket of halves holds on average, and those of a block.
BUCKET, BLOCK = 16_384, 65_536
LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every run of letters of whole texts, A-Z in lower case; a null id is ''."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), 1)).alias("run"))


def thinned(id_: Column, run: Column, every: int = 97) -> Column:
    """The run; where `every` divides the crc32 of '<id>:<run>', without the symbol that the crc32 points to."""
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the different results of `thinned` over all runs, of at least `least_length` symbols and `least_count` occurrences."""
    words = runs(docs, id_col, text_col).where(F.length("run") >= least_length).select(thinned(F.col("id"), F.col("run"), every).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(kind, bucket, word, n) of the words to be found and of the words that look. A word looks under its first half (kind 0) and its second one (kind 1), and is found
    under what would be such a half of words one symbol shorter, as long and one longer."""
    size = F.length("word")
    first, last = lambda n: F.substring("word", F.lit(1), n), lambda n: F.substring("word", size - n + 1, n)
    low = [F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    high = [F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    bucket = lambda kind, half: F.pmod(F.xxhash64(F.lit(kind), half), F.lit(buckets)).cast("int")
    place = lambda kind, half: F.struct(F.lit(kind).alias("kind"), bucket(kind, half).alias("bucket"))
    found = F.explode(F.array_distinct(F.array(*(place(0, first(n)) for n in low), *(place(1, last(n)) for n in high)))).alias("p")
    looks = F.explode(F.array(place(0, first(low[1])), place(1, last(high[1])))).alias("p")
    return tuple(words.select(x, "word", "n").select("p.kind", "p.bucket", "word", "n") for x in (found, looks))


def near(words: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of a table (word, n) of different words: how many others are one inserted, deleted or replaced symbol away, and the most frequent
    of them (ties: the least by symbols). Words without such have no row. Words are of two symbols at least and hold no line break.

    A bucket of more than `block` words is dealt into blocks, each pair of which (words that look, words to be found) is a group of its own.
    """
    buckets = max(1, -(-2 * words.count() // bucket))
    found, looks = _halves(words, buckets)
    sizes = found.groupBy("kind", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    large = sizes.where("blocks > 1")  # few: each stands for over `block` rows

    def dealt(rows: DataFrame, role: int) -> DataFrame:
        rows = rows.join(large, ["kind", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumns({"own": F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int"), "all": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
        places = {"found": "own", "looks": "all"} if role == 0 else {"found": "all", "looks": "own"}
        return rows.select("kind", "bucket", *(F.col(c).alias(k) for k, c in places.items()), F.lit(role).alias("role"), "word", "n")

    def search(group: pa.RecordBatch) -> pa.RecordBatch | None:
        role = group.column("role").to_numpy()
        names, counts = group.column("word").to_pylist(), group.column("n").to_numpy()
        mine, other = (role == 1).nonzero()[0], (role == 0).nonzero()[0]
        if not len(mine) or not len(other):
            return None
        kind = group.column("kind")[0].as_py()
        index, looking = WordIndex([names[i] for i in other]), [names[i] for i in mine]
        n_of = counts[other].tolist()
        best: dict[int, tuple] = {}
        for query, hit in index.near(looking, kind == 0):
            for i, k in zip(query.tolist(), hit.tolist(), strict=True):
                word, form = looking[i], index.words[k]
                if kind and form.startswith(word[: len(word) // 2]):  # met under the first half, too
                    continue
                n, top = best.get(i, (0, None))
                now = (-n_of[k], form)
                best[i] = (n + 1, now if top is None or now < top else top)
        rows = [(looking[i], n, form, -less) for i, (n, (less, form)) in best.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

    rows = dealt(found, 0).unionByName(dealt(looks, 1))
    parts = by_group(rows, ["kind", "bucket", "found", "looks"], search, "word string, n_near long, form string, form_n long")
    top = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("top")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", F.col("top.form").alias("form"), (-F.col("top.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps from word to form of a table without circles end. Each round doubles the steps taken and writes its table."""
    now = written(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97, ratio: int = 2, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the corpus's words.

    form: the near word with the largest n (ties: the least by symbols), if that n is at least `ratio` times the word's, else null; root: the last of the forms' forms, or the word itself.
    `least_length` is two at least. Null and empty texts give no words, a null id counts as '', repeated rows count each, other columns are ignored, an empty table gives no rows.
    """
    words = written(vocabulary(docs, id_col, text_col, least_length, least_count, every), "words")
    found = words.join(near(words, bucket, block), "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    table = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "near")
    return table.join(roots(table.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of documents with their near words, forms and roots."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
