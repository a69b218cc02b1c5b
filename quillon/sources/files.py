"""Sources: text files as documents, dictionaries, page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.regex import let, to_java
from quillon.sources.output import tokens_of

MAX_BYTES = 50 * 1024 * 1024


def read_texts(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, encoding, source, size, modified of every file below a path: UTF-8, else Latin-1.

    Empty and oversized files raise when they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.when(F.col("length") == 0, F.raise_error(F.concat(F.lit("empty file: "), "path"))).when(
        F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("file too large: "), "path"))
    ).otherwise(F.col("content"))
    utf8 = F.is_valid_utf8(F.col("bytes").cast("string"))
    return files.withColumn("bytes", fits).select(
        F.xxhash64("path").alias("doc_id"),
        F.when(utf8, F.col("bytes").cast("string")).otherwise(F.decode("bytes", "ISO-8859-1")).alias("text"),
        F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"),
        F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )


def spread(rows: DataFrame, least: int = 2000) -> DataFrame:
    """Rows over all cores if the table has at least `least` rows in fewer parts than there are cores.

    A file of one row group is one task however the reader is set, and detection is dear per row. A table of parts enough, as large ones have,
    stays as it is and is not shuffled. The count reads no column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    return rows.repartition(cores) if parts["n"] < cores and (parts["rows"] or 0) >= least else rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts of PDF files as documents with `[PAGE n]` marks; needs a PDF library on the workers."""
    import pyarrow as pa

    def pages(batches):
        import pymupdf  # only where it is installed

        for b in batches:
            texts = []
            for data in b.column("content"):
                with pymupdf.open(stream=data.as_py(), filetype="pdf") as doc:
                    marked = []
                    for n, page in enumerate(doc, 1):
                        blocks = [x[4].strip() for x in page.get_text("blocks", sort=True) if x[6] == 0 and x[4].strip()]
                        marked.append("\n".join([f"[PAGE {n}]", *blocks]))
                    texts.append("\n\n".join(marked))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts)], names=["source", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(pages, "source string, text string").withColumn("doc_id", F.xxhash64("source"))


def read_entries(spark: SparkSession, path: str, stops: str | None = None) -> DataFrame:
    """Entries of a dictionary file, one a line, `#` for remarks, without those of a stop list."""

    def lines(p: str) -> DataFrame:
        return spark.read.text(p).select(F.btrim("value").alias("entry")).where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#"))).distinct()

    out = lines(path)
    if stops:
        left = lines(stops).select(F.lower("entry").alias("stop"))
        out = out.join(left, F.lower(out["entry"]) == left["stop"], "left_anti")
    return out


def dictionary_spans(docs: DataFrame, entries: DataFrame, entity: str, tag: str, score: float, words: int | None = None) -> DataFrame:
    """doc_id and spans of listed entries, for lists too large for a pattern: n-grams of each text joined to the entries by hash.

    Case is folded; n-grams have up to `words` words, as many as the longest entry unless a caller says otherwise.
    """
    word = r"[^\s,.;:()\"]+"
    if words is None:
        words = max(entries.agg(F.max(F.regexp_count("entry", F.lit(word)))).first()[0] or 1, 1)
    t, java = F.coalesce("text", F.lit("")), to_java(word).pattern
    # tokens and the gaps before them in turn, so that a gram is a slice of them and no text is cut again
    pieces = let(F.split(t, java, -1), lambda gaps: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(java), F.lit(0)), lambda m, i: F.array(F.get(gaps, i), m))))
    at = docs.select("doc_id", tokens_of(t, word).alias("t"), pieces.alias("p"))
    gram = lambda x, i, k: F.struct(x["start"].alias("start"), F.array_join(F.slice("p", 2 * i + 2, 2 * k + 1), "").alias("text"))
    whole = lambda x, i: F.transform(F.sequence(F.lit(0), F.least(F.lit(words), F.size("t") - i) - 1), lambda k: gram(x, i, k))
    grams = at.select("doc_id", F.explode_outer(F.flatten(F.transform("t", whole))).alias("g")).where("g IS NOT NULL")
    keyed = grams.select(
        "doc_id", F.col("g.start").alias("start"), (F.col("g.start") + F.length("g.text")).cast("int").alias("end"), F.col("g.text").alias("text"), F.lower(F.regexp_replace("g.text", r"\s+", " ")).alias("key")
    )
    listed = entries.select(F.lower("entry").alias("key")).distinct()
    return keyed.join(listed, "key", "left_semi").select("doc_id", "start", "end", F.lit(entity).alias("entity_type"), "text", F.lit(score).alias("score"), F.lit(tag).alias("recognizer"))
