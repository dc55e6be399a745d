"""Assemble the lexical network: one nested record per word sense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.text import clean_definition, concat_nullable, extract_elements, html_to_text
from lexlake.operators.joins import decode, decode_list, self_lookup
from lexlake.operators.keyed import lookup, ordered_lists
from lexlake.sources.files import read_delimited
from lexlake.sources.markup import markup_dictionary, read_markup

# Table layouts of the lexical network files.
NODES = "id string, entry string, lexnum string, status int, `%` double"
ENTRIES = "id string, addtoname string, name string"
GRAMMAR = "node string, usagenote string, usagenotevars string, POS string"
DEFINITIONS = "node string, def_HTML string, def_XML string"
EDGES = "source string, lf string, target string"
EXAMPLES = "id string, status string, content string"
EXAMPLE_LINKS = "node string, example string, occurrence string, position int"


def in_file_order(df: DataFrame) -> DataFrame:
    """Add ``pos``, the place in the file, unless the table brings it.

    Row ids follow the file only for a table read from one file; tables in many
    files must carry ``pos`` themselves.
    """
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def node_names(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with the full name of their entry."""
    named = entries.select(
        F.col("id").alias("entry_id"), concat_nullable(F.col("addtoname"), F.col("name")).alias("name")
    )
    base = nodes.select(
        F.col("id").alias("node_id"), F.col("entry").alias("entry_id"), "lexnum", "status", "%"
    )
    return base.join(named, "entry_id", "left")


def relation_lists(edges: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """Per source node the relations in file order: function name, link type, target name.

    An unknown relation or target id keeps its row with a null name.
    """
    placed = in_file_order(edges)
    order = names.select("node_id", "name", F.monotonically_increasing_id().alias("_row"))
    named = self_lookup(placed, "target", order, "node_id", "name", "_row", "target_name")
    dim = relations.select(
        F.col("id").alias("lf"), F.col("name").alias("lf_name"), "linktype"
    )
    full = lookup(named, dim, ["lf"])
    item = F.struct(
        F.col("lf_name").alias("lexical_function"), F.col("linktype"), F.col("target_name").alias("target")
    )
    return ordered_lists(full, ["source"], "pos", item, "lf_dict").withColumnRenamed("source", "node_id")


def example_lists(links: DataFrame, examples: DataFrame, last_position: int = 2) -> DataFrame:
    """Per node the first examples as (text, occurrence, position), in file order."""
    texts = examples.select(F.col("id").alias("example"), html_to_text(F.col("content")).alias("text"))
    near = in_file_order(links).where(F.col("position") <= last_position)
    item = F.struct("text", "occurrence", "position")
    return ordered_lists(
        near.join(texts, "example", "left"), ["node"], "pos", item, "examples"
    ).withColumnRenamed("node", "node_id")


def assemble(
    nodes: DataFrame,
    entries: DataFrame,
    grammar: DataFrame,
    grammar_names: DataFrame,
    definitions: DataFrame,
    edges: DataFrame,
    relations: DataFrame,
    links: DataFrame,
    examples: DataFrame,
) -> DataFrame:
    """One record per node with its whole lists; repeated grammar or definition rows repeat the node."""
    named = node_names(nodes, entries)
    marks = grammar.withColumn("_row", F.monotonically_increasing_id())
    marks = decode_list(marks, "usagenote", grammar_names, "usagenote_names", ["_row"])
    marks = decode(marks, "POS", grammar_names, "pos_name").select(
        F.col("node").alias("node_id"),
        F.col("usagenote_names").alias("usagenote"),
        "usagenotevars",
        F.col("pos_name").alias("POS"),
    )
    described = definitions.select(
        F.col("node").alias("node_id"),
        clean_definition(html_to_text(F.col("def_HTML"))).alias("definition"),
        extract_elements(F.col("def_XML"), "actantpos", "tc").alias("actants"),
    )
    return (
        named.join(marks, "node_id", "left")
        .join(described, "node_id", "left")
        # One after the other: a full join of the two would deal all lists and texts out once more.
        .join(relation_lists(edges, named, relations), "node_id", "left")
        .join(example_lists(links, examples), "node_id", "left")
        .select(
            "node_id", "entry_id", "name", "lexnum", "POS", "usagenote", "usagenotevars", "definition",
            "actants", "lf_dict",
            F.coalesce("examples", F.array().cast("array<struct<text:string,occurrence:string,position:int>>")).alias("examples"),
            "status", "%",
        )
    )


def dictionary_of(spark: SparkSession, path: str, tag: str, *attributes: str) -> DataFrame:
    """(id, name, ...) of a markup dictionary file; the last entry of an id wins."""
    entries = markup_dictionary(read_markup(spark, path), "markup", tag, ["id", "name", *attributes])
    rest = ["name", *attributes]
    last = entries.groupBy("id").agg(F.max_by(F.struct(*rest), "pos").alias("e"))
    return last.select("id", *[F.col(f"e.{c}") for c in rest])


def read_network(spark: SparkSession, folder: str) -> DataFrame:
    """Assemble the network from the files of one folder."""
    # File names of the lexical network.
    tables = {
        "nodes": ("01-lsnodes.csv", NODES),
        "entries": ("02-lsentries.csv", ENTRIES),
        "grammar": ("06-lsgramcharac-rel.csv", GRAMMAR),
        "definitions": ("13-lsdef.csv", DEFINITIONS),
        "edges": ("15-lslf-rel.csv", EDGES),
        "examples": ("17-lsex.csv", EXAMPLES),
        "links": ("18-lsex-rel.csv", EXAMPLE_LINKS),
    }
    prose = {"definitions", "examples"}  # only these have line breaks inside cells
    read = {
        k: read_delimited(spark, f"{folder}/{name}", schema, multiline=k in prose)
        for k, (name, schema) in tables.items()
    }
    return assemble(
        **read,
        grammar_names=dictionary_of(spark, f"{folder}/05-lsgramcharac-model.xml", "characteristic"),
        relations=dictionary_of(spark, f"{folder}/14-lslf-model.xml", "lexicalfunction", "linktype"),
    )
