"""Streaming corpus intake: strip, length filter, cut, shuffle, append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.operators.joins import corpus_filter
from lexlake.operators.sampling import first_n, hash_cuts, seeded_hash
from lexlake.session import scratch_path, written

BUFFER = 10_000


def stream_corpus(
    spark: SparkSession,
    source: str,
    schema: T.StructType | None,
    target: str,
    col: str = "text",
    min_len: int = 50,
    max_len: int = 4000,
    n: int | None = None,
    shuffle_seed: int | None = None,
    row_id: str | None = None,
    max_files: int = 1000,
    fmt: str = "parquet",
    buffer: int = BUFFER,
) -> None:
    """Read the files under ``source`` that were not read before and append to ``target``.

    ``fmt`` is parquet, json (one document per line) or text (one text per line, named ``col``; no schema). Offsets and the commit
    log live next to ``target``, so a restart goes on where the last run ended. ``shuffle_seed`` lets texts
    pass through a buffer of ``buffer`` rows: each micro-batch mixes with it, all but as many rows, drawn at random, are
    appended, the others wait; what waits at the end of the run is appended last. ``n`` stops after that
    many texts over all batches and runs, after the shuffle. A run that fails and is started again gives the same rows.
    """
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", max_files)
    raw = reader.load(source).withColumnRenamed("value", col) if fmt == "text" else reader.schema(schema).load(source)
    texts = corpus_filter(raw, col, min_len, max_len)
    writer = texts.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{target}-progress")
    if n is None and shuffle_seed is None:
        writer.format("parquet").option("path", target).outputMode("append").start().awaitTermination()
        return
    pool = _Pool(spark, target, texts.schema, n, shuffle_seed, row_id or col, buffer if shuffle_seed is not None else 0)
    writer.foreachBatch(pool.take).start().awaitTermination()
    pool.flush()


class _Pool:
    """Waiting rows and the number of appended ones, kept as files next to the target.

    Batch b is step 2b, the end of a run behind it step 2b + 1. A step writes its rows, then those that wait, then a mark
    (step, taken, waiting). It starts from the last mark before it, so a repeated step replaces what it left and gives the same.
    """

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, n: int | None, seed: int | None, row_id: str, keep: int) -> None:
        self.spark, self.target, self.schema = spark, target, schema
        self.n, self.seed, self.row_id, self.keep = n, seed or 0, row_id, keep

    def _last(self, before: int | None = None) -> tuple[int, int, int] | None:
        try:
            marks = self.spark.read.schema("step long, taken long, waiting long").parquet(f"{self.target}-state/marks/*")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if before is not None:
            marks = marks.where(F.col("step") < before)
        last = marks.orderBy(F.desc("step")).first()
        return tuple(last) if last else None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch, 2 * batch_id, self._last(2 * batch_id), self.keep)

    def flush(self) -> None:
        last = self._last()
        if last is None:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.target}/step=0")
        elif last[2]:
            self._step(None, last[0] + 1, last, 0)

    def _step(self, batch: DataFrame | None, step: int, last: tuple[int, int, int] | None, keep: int) -> None:
        before, taken, waiting = last or (-1, 0, 0)
        wanted = None if self.n is None else self.n - taken
        if wanted is not None and wanted <= 0:
            return
        rows = batch
        if waiting:
            old = self.spark.read.schema(self.schema).parquet(f"{self.target}-state/rows/step_{before}")
            rows = old if batch is None else batch.unionByName(old)
        # A hash of the step and the row: the same in a repeated step, new for each row in each step.
        pool = written(rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(step)), seeded_hash(self.seed, self.row_id)))), "pool")
        size = pool.count()
        out = max(size - keep, 0)
        if wanted is not None and out >= wanted:
            chosen, rest, out = first_n(pool, wanted, ["_h"]), None, wanted
        elif out == size:
            chosen, rest = pool.orderBy("_h"), None
        else:
            bound = hash_cuts(pool, [], F.col("_h"), lambda sizes: sizes.select(F.lit(0).alias("cut"), F.lit(out).alias("r"))).first()["bound"]
            chosen, rest = pool.where(F.col("_h") <= bound).orderBy("_h"), pool.where(F.col("_h") > bound)
            # Rows of equal hash (equal texts) go together.
            out = chosen.count()
        chosen.drop("_h").write.mode("overwrite").parquet(f"{self.target}/step={step}")
        if rest is not None:
            rest.drop("_h").write.mode("overwrite").parquet(f"{self.target}-state/rows/step_{step}")
        mark = self.spark.createDataFrame([(step, taken + out, 0 if rest is None else size - out)], "step long, taken long, waiting long")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.target}-state/marks/step_{step}")


def streamed_corpus(
    spark: SparkSession, source: str, schema: T.StructType | None, **options: object
) -> DataFrame:
    """Run ``stream_corpus`` into a fresh shared folder and read the result."""
    target = scratch_path(spark, "corpus")
    stream_corpus(spark, source, schema, target, **options)
    if schema is None:
        schema = T.StructType([T.StructField(str(options.get("col", "text")), T.StringType())])
    return spark.read.schema(schema).parquet(target)
