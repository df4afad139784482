"""Labelled data sets: canonical hashes, label and prediction pairing, validation, graph records, vocabularies."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.order import positions
from quarrylens.sources.shared import materialize

#: Fixed value: the tokens of the source language, comments first. Literals are written as unrolled loops, which need no
#: stack however long they are.
TOKENS = (
    r"//[^\n]*|/\*[\s\S]*?\*/"
    r'|(?:u8|u|U|L)?R"(?<delim>[^\s()\\]{0,16})\([\s\S]*?\)\k<delim>"'
    r'|(?:u8|u|U|L)?"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|(?:u8|u|U|L)?'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|[A-Za-z_]\w*"
    r"|(?:\d+(?:\.\d*)?|\.\d+)(?:[eEpP][+-]?\d+)?[a-zA-Z0-9_]*"
    r"|>>=|<<=|->\*|<=>|\.\.\.|::|->|\.\*|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\|"
    r"|\+=|-=|\*=|/=|%=|&=|\|=|\^=|##|[^\s]"
)


def canonical_hash(source: Column) -> Column:
    """SHA-256 of the tokens without comments, joined by a space; of the text itself where line ends carry meaning
    (a preprocessor line or a line splice)."""
    tokens = F.filter(F.regexp_extract_all(source, F.lit("(?U)" + TOKENS), F.lit(0)), lambda t: ~(t.startswith("//") | t.startswith("/*")))
    exact = source.contains("#") | source.contains("\\\n") | source.contains("\\\r\n")
    return F.sha2(F.when(exact, source).otherwise(F.array_join(tokens, " ")), 256)


def pair_exactly(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Rows of both sides with equal keys; a key that one side lacks, or has twice, is an error when read."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    a, b = left.withColumn("_a", n), right.withColumn("_b", n)
    both = a.join(b, key, "full")
    wrong = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") > 1) | (F.col("_b") > 1)
    return both.withColumn(key, F.when(wrong, F.raise_error(F.concat(F.lit(f"{what} do not match one to one: "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_a", "_b")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that do not match one to one, with how often each side has them."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.sum("l").alias("lefts"), F.sum("r").alias("rights")).where("lefts != 1 or rights != 1")


def join_labels(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Graphs with their labels on file and function, and on signature where the label gives one; those that match nothing
    are left out (see ``labels_one_to_one``)."""
    lab = labels.select(F.col("file").alias("_f"), F.col("function").alias("_n"), F.col("signature").alias("_s"), *[c for c in labels.columns if c not in ("file", "function", "signature")])
    on = (F.col("file") == F.col("_f")) & (F.col("function") == F.col("_n")) & (F.col("_s").isNull() | (F.col("signature") == F.col("_s")))
    return graphs.join(lab, on).drop("_f", "_n", "_s")


def labels_one_to_one(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Graphs with their labels on file and function, and on signature where the label gives one. Graphs and labels must
    match one to one: a graph without a label or with several, a label of several graphs (say its signature) or of none
    is an error when read. Null files or functions match nothing. Both sides are written once, numbered."""
    names = ("file", "function", "signature")
    lab = materialize(labels.withColumn("_l", F.monotonically_increasing_id()), "labels")
    own = materialize(graphs.withColumn("_g", F.monotonically_increasing_id()), "graphs")
    rest = [c for c in labels.columns if c not in names]
    right = lab.select(F.col("file").alias("_f"), F.col("function").alias("_n"), F.col("signature").alias("_s"), "_l")
    on = (F.col("file") == F.col("_f")) & (F.col("function") == F.col("_n")) & (F.col("_s").isNull() | (F.col("signature") == F.col("_s")))
    links = materialize(own.select("_g", *names).join(right, on, "full").select("_g", "_l"), "links")
    count = lambda key, other: links.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(other).alias(f"{key}_n"), F.min(other).alias(f"{key}_other"))
    by_graph, by_label = count("_g", "_l"), count("_l", "_g")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.concat_ws(":", "file", "function"), F.lit("?"))))
    checked = own.join(by_graph, "_g").join(by_label.select(F.col("_l").alias("_g_other"), "_l_n"), "_g_other", "left")
    sure = F.when(F.col("_g_n") == 0, fail("a graph without a label: ")).when(F.col("_g_n") > 1, fail("a graph with several labels: ")).when(F.col("_l_n") > 1, fail("a label of several graphs: ")).otherwise(F.col("file"))
    paired = checked.withColumn("file", sure).join(lab.select(F.col("_l").alias("_g_other"), *rest), "_g_other", "left").select(*graphs.columns, *rest)
    lost = lab.join(by_label.where("_l_n = 0").select("_l"), "_l").withColumn("file", fail("a label without a graph: "))
    return paired.unionByName(lost.select("file", *[F.lit(None).cast(paired.schema[c].dataType).alias(c) for c in paired.columns if c != "file"]))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row per rule that a record breaks (a condition that is false or null), in one pass."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """function, nodes (in order) and edges (source and target places, type): nodes have function, node, ord and kind,
    edges function, source, target and type. An edge that names no node of its function is an error when read."""
    place = nodes.select("function", "node", (F.row_number().over(W.partitionBy("function").orderBy("ord")) - 1).alias("place"))
    at = lambda side: place.select("function", F.col("node").alias(side), F.col("place").alias(f"{side}_at"))
    placed = edges.join(at("source"), ["function", "source"], "left").join(at("target"), ["function", "target"], "left")
    sure = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("an edge names a missing node"))).otherwise(F.col(c))
    links = placed.groupBy("function").agg(F.sort_array(F.collect_list(F.struct(sure("source_at").alias("source"), sure("target_at").alias("target"), F.col("type")))).alias("edges"))
    kinds = nodes.groupBy("function").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "node", "kind"))), lambda x: F.struct(x["node"].alias("node"), x["kind"].alias("kind"))).alias("nodes"))
    return kinds.join(links, "function", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:int,target:int,type:int>>")))


def with_reverse(edges: DataFrame, keep: list[int] | None = None, shift: int = 4) -> DataFrame:
    """Edges of the kept types, and each turned round with its type raised by ``shift``."""
    own = edges if keep is None else edges.where(F.col("type").isin(keep))
    return own.unionByName(own.withColumns({"source": F.col("target"), "target": F.col("source"), "type": F.col("type") + shift}))


def number_feature(c: Column) -> Column:
    """The sign of a number times the log of its size, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.signum(c) * F.log1p(F.abs(c)) / 10))


def fit_vocabulary(train: DataFrame, word: str) -> DataFrame:
    """word and index (from 1, in order, null first) of the distinct words of the training rows, however many."""
    placed = positions(train.select(word).distinct(), [F.col(word).asc_nulls_first()], "index")
    return placed.withColumn("index", F.col("index") + 1)


def encode_words(rows: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    """Rows with their word's index; 0 for words that training has not seen."""
    return rows.join(vocabulary, word, "left").withColumn("index", F.coalesce("index", F.lit(0)).cast("long"))


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a field is given twice")
    return out


def _finite(x: str) -> float:
    if not math.isfinite(value := float(x)):
        raise ValueError("not a finite number")
    return value


def _strict(text: str | None) -> str | None:
    try:
        value = json.loads(text or "", object_pairs_hook=_no_repeats, parse_float=_finite, parse_constant=_finite)
    except ValueError as error:
        return str(error)
    return None if isinstance(value, dict) else "not an object"


@F.pandas_udf(T.StringType())
def json_problem(text: pd.Series) -> pd.Series:
    """Why a line is no strict JSON object (repeated fields, non-finite numbers, syntax), or null."""
    return text.map(_strict).astype(object)


def _decode(data: bytes) -> tuple[str | None, str]:
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return None, "unknown"


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text of bytes as UTF-8, else GB18030, and which; null text where neither holds."""
    return pd.DataFrame([_decode(bytes(c)) for c in content], columns=["text", "encoding"], dtype=object)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and content of ZIP files, a row per member. Members that leave their folder, or differ only by
    case from another, make their archive an error. An archive is read in one task."""
    import io
    import zipfile

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [i for i in z.infolist() if not i.is_dir()]
                    names = [i.filename for i in members]
                    if any(n.startswith("/") or ".." in n.split("/") or "\\" in n or ":" in n for n in names) or len({n.casefold() for n in names}) < len(names):
                        raise ValueError(f"unsafe member names in {name}")
                    for i in members:
                        yield pd.DataFrame({"archive": [name], "member": [i.filename], "content": [z.read(i)]}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")
