"""Query registry and the derived views, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexlake.operators.keyed import spread
from lexlake.session import written

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    sql: str | None


REGISTRY: dict[str, Entry] = {}
_SCHEMAS: dict[str, StructType] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of ``Tables`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        REGISTRY[name] = Entry(lambda spark, folder: build(Tables(spark, folder)), sql)
        return build

    return register


class Tables:
    """The given tables and the views derived from them; everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:  # reading a footer is a job, so do it once per table
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @property
    def v_rel(self) -> DataFrame:
        line = spread(self.lineitem.select("l_partkey", "l_suppkey"))
        part = self.part.select("p_partkey", "p_name", "p_type")
        supplier = self.supplier.select("s_suppkey", "s_name")
        return (
            line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_partkey").alias("source"),
                F.col("p_name").alias("name"),
                F.col("p_type").alias("pos"),
                lf_of(F.col("l_suppkey")).alias("lf"),
                F.col("s_name").alias("target"),
            )
        )

    @property
    def v_targets(self) -> DataFrame:
        return self.v_rel.select("name", "pos", "lf", "target").distinct()

    @property
    def v_groups(self) -> DataFrame:
        return (
            self.v_targets.groupBy("name", "pos", "lf")
            .agg(F.count(F.lit(1)).alias("n_targets"), F.min("target").alias("first_target"))
            .select(F.concat_ws("||", "name", "pos", "lf").alias("group_id"), "name", "pos", "lf", "n_targets", "first_target")
        )

    def groups_table(self) -> DataFrame:
        """``v_groups`` written once, for operators that read their input more than once."""
        return written(self.v_groups, "groups")

    @property
    def v_edges(self) -> DataFrame:
        line = self.lineitem.select("l_partkey", "l_suppkey").distinct()
        return line.join(
            self.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")
        ).select(
            F.col("l_partkey").alias("node_id"),
            F.col("l_suppkey").alias("ord"),
            lf_of(F.col("l_suppkey")).alias("lf"),
            F.col("s_name").alias("target"),
        )

    @property
    def v_eval(self) -> DataFrame:
        docs = self.documents.select("doc_id", "source", "lang", "n_chars")
        return docs.join(self.labels.select("doc_id", "quality"), "doc_id").select(
            "doc_id",
            F.col("source").alias("model"),
            F.col("lang").alias("task_name"),
            F.col("quality").cast("string").alias("ground_truth"),
            (F.col("n_chars") % 2).cast("string").alias("prediction"),
            F.when(F.col("quality") == F.col("n_chars") % 2, 1).otherwise(0).alias("is_correct"),
        )

    @property
    def v_occ(self) -> DataFrame:
        st = (F.col("doc_id") * 37) % F.greatest("n_chars", F.lit(1))
        en = F.least(st + 8, F.col("n_chars"))
        return self.documents.select(
            "doc_id", "text", "n_chars", st.alias("st"), en.alias("en"),
            F.concat(F.lit("("), st, F.lit(";"), en, F.lit(")")).alias("occurrence"),
        )

    @property
    def v_answers(self) -> DataFrame:
        k, name = F.col("p_partkey"), F.col("p_name")
        answer = (
            F.when(k % 5 == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" assistant")))
            .when(k % 7 == 0, F.concat(F.lit("une "), name))
            .when(k % 11 == 0, F.lit(None))
            .otherwise(name)
        )
        return self.part.select("p_partkey", "p_brand", answer.alias("answer"))

    @property
    def v_answer_targets(self) -> DataFrame:
        return self.part.select("p_brand", F.col("p_name").alias("target")).distinct()

    @property
    def v_gen(self) -> DataFrame:
        # Stand-in answers, by doc_id modulo their number.
        answers = [" 1. ", "0 or 1", "label: 0", "10", "", "the answer is 1, sure", "oui", "0"]
        truths = ["Yes, it is", "no", "unknown"]
        pick = lambda texts: F.element_at(
            F.array(*[F.lit(x) for x in texts]), (F.col("doc_id") % len(texts) + 1).cast("int")
        )
        return self.labels.select("doc_id", "quality", pick(answers).alias("gen_text"), pick(truths).alias("truth_text"))

    @property
    def v_patterns(self) -> DataFrame:
        return self.spark.createDataFrame(PATTERNS, "lf string, pattern_no int, pattern string, one_shot string")


def lf_of(key: F.Column) -> F.Column:
    """Stand-in relation name: skewed, seven values at 100 suppliers."""
    return F.concat(F.lit("LF_"), F.length(F.bin(key + 1)))


# Stand-in prompt templates. LF_1 has none on purpose.
PATTERNS = [
    ("LF_2", 1, "What goes with <W>?", "A goes with B"),
    ("LF_3", 1, "Name <W>", ""),
    ("LF_3", 2, "Which one is <W>?", ""),
    ("LF_4", 1, "Who has <W>?", "X has Y"),
    ("LF_5", 1, "Find <W>", "F"),
    ("LF_6", 1, "Say <W>", "S"),
    ("LF_7", 1, "Show <W>", "T"),
]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_rel": ((), """
select l.l_partkey as source, p.p_name as name, p.p_type as pos,
       concat('LF_', length(bin(l.l_suppkey + 1))) as lf, s.s_name as target
from lineitem l join part p on p.p_partkey = l.l_partkey join supplier s on s.s_suppkey = l.l_suppkey"""),
    "v_targets": (("v_rel",), "select distinct name, pos, lf, target from v_rel"),
    "v_groups": (("v_targets",), """
select concat(name, '||', pos, '||', lf) as group_id, name, pos, lf, count(*) as n_targets, min(target) as first_target
from v_targets group by name, pos, lf"""),
    "v_edges": ((), """
select l.l_partkey as node_id, l.l_suppkey as ord, concat('LF_', length(bin(l.l_suppkey + 1))) as lf, s.s_name as target
from (select distinct l_partkey, l_suppkey from lineitem) l join supplier s on s.s_suppkey = l.l_suppkey"""),
    "v_eval": ((), """
select d.doc_id, d.source as model, d.lang as task_name, cast(l.quality as varchar) as ground_truth,
       cast(d.n_chars % 2 as varchar) as prediction,
       case when l.quality = d.n_chars % 2 then 1 else 0 end as is_correct
from documents d join labels l on l.doc_id = d.doc_id"""),
    "v_occ": ((), """
select doc_id, text, n_chars, (doc_id * 37) % greatest(n_chars, 1) as st,
       least((doc_id * 37) % greatest(n_chars, 1) + 8, n_chars) as en from documents"""),
    "v_answers": ((), """
select p_partkey, p_brand, case when p_partkey % 5 = 0 then concat(' ', upper(p_name), ' assistant')
       when p_partkey % 7 = 0 then concat('une ', p_name) when p_partkey % 11 = 0 then null else p_name end as answer
from part"""),
    "v_answer_targets": ((), "select distinct p_brand, p_name as target from part"),
    "v_gen": ((), """
select doc_id, quality, case doc_id % 8 when 0 then ' 1. ' when 1 then '0 or 1' when 2 then 'label: 0' when 3 then '10'
        when 4 then '' when 5 then 'the answer is 1, sure' when 6 then 'oui' else '0' end as gen_text,
       case doc_id % 3 when 0 then 'Yes, it is' when 1 then 'no' else 'unknown' end as truth_text from labels"""),
    "v_patterns": ((), "select * from (values "
        + ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in PATTERNS)
        + ") as t(lf, pattern_no, pattern, one_shot)"),
}


def with_views(*names: str) -> str:
    """``with`` clause that defines the named views and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in ordered) + "\n"


def split_sql(rows: str) -> str:
    """CTE ``cuts`` (lf, train, upto): the sizes of train, and of train and val, per stratum of ``rows`` at 80/10/10."""
    tie = "md5(concat('42|', lf))"
    return f"""sz as (select lf, cast(count(*) as hugeint) as n from {rows} group by lf),
sz1 as (select *, cast(sum(n) over () as hugeint) as total from sz),
sz2 as (select *, total - cast(ceil(cast(total as double) * (1 - 0.8::double)) as hugeint) as d from sz1),
sz3 as (select *, n * d // total as whole, n * d % total as rem from sz2),
sz4 as (select lf, total - d as rest, whole + case when row_number() over (order by rem desc, {tie}) <= d - sum(whole) over () then 1 else 0 end as train, n from sz3),
sz5 as (select *, n - train as m, rest - cast(ceil(cast(rest as double) * 0.5) as hugeint) as d from sz4),
sz6 as (select *, case when rest = 0 then 0 else m * d // rest end as whole, case when rest = 0 then 0 else m * d % rest end as rem from sz5),
cuts as (select lf, train, train + whole + case when row_number() over (order by rem desc, {tie}) <= d - sum(whole) over () then 1 else 0 end as upto from sz6)"""
