"""Hierarchical codes (O1): codes as paths of a tree.

Drug, diagnosis and procedure codes are trees written as strings: the first characters name
a class, the next ones a subclass. A code becomes one token for each of its levels
(``ATC_1_A10``, ``ATC_2_B``, ``ATC_3_A02``), so that codes of one class share tokens, and the
tokens of a code spell it again. The same levels give the tree itself (every prefix is a node
below its parent) and roll counts of events and persons up to all ancestors.

Everything is a Catalyst expression over ``(system, code)``; the fan-out of a code is the
number of its levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_code(code) -> Column:
    """Upper case, without dots and white space; NULL for an empty code."""
    bare = F.upper(F.regexp_replace(_c(code), r"[.\s]", ""))
    return F.when(bare != "", bare)


def code_pieces(system, code) -> Column:
    """The parts of a code by level, as far as it reaches; NULL for an unknown system or no code."""
    bare = normal_code(code)
    out = F.lit(None).cast("array<string>")
    for name, widths in K.CODE_LEVELS.items():
        at, parts = 1, []
        for w in widths:
            parts.append(F.substring(bare, at, w) if w else F.substring(bare, F.lit(at), F.length(bare)))
            at += w
        out = F.when(_c(system) == name, F.filter(F.array(*parts), lambda x: x != "")).otherwise(out)
    return F.when(bare.isNotNull(), out)


def code_tokens(system, code) -> Column:
    """``<SYSTEM>_<level>_<piece>`` for each level of the code."""
    return F.transform(code_pieces(system, code), lambda x, i: F.concat_ws("_", _c(system), (i + 1).cast("string"), x))


def code_of_tokens(tokens) -> Column:
    """The (normal) code that the tokens of one code spell."""
    return F.array_join(F.transform(_c(tokens), lambda t: F.regexp_replace(t, "^[^_]*_[0-9]+_", "")), "")


def node_path(pieces: Column) -> Column:
    """Nodes from the top level down, ``(level, node, parent)``, of the parts of a code."""
    prefix = lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "")
    return F.transform(pieces, lambda x, i: F.struct(
        (i + 1).cast("int").alias("level"), prefix(i + 1).alias("node"), F.when(i > 0, prefix(i)).alias("parent")))


def code_path(system, code) -> Column:
    """Nodes from the top level to the code itself: ``(level, node, parent)``, a node being the code's prefix."""
    return node_path(code_pieces(system, code))


def code_tree(codes: DataFrame) -> DataFrame:
    """Distinct nodes of the codes ``(system, code)``: ``(system, level, node, parent)``."""
    return codes.select("system", F.explode(code_path("system", "code")).alias("p")).select("system", "p.*").distinct()


def coded_concepts(codes: DataFrame) -> DataFrame:
    """``(et, cid, tokens)`` of the concepts ``(et, cid, system, code)`` that have a code. Several codes of a concept
    leave the least."""
    one = codes.groupBy("et", "cid").agg(F.min(F.struct("system", "code")).alias("c"))
    return one.select("et", "cid", code_tokens("c.system", "c.code").alias("tokens")).where(F.col("tokens").isNotNull())


def coded_counts(concept_counts: DataFrame, coded: DataFrame) -> DataFrame:
    """``(token, n)`` for a vocabulary: concepts with a code count for each token of it, the others for their own."""
    j = concept_counts.join(coded, ["et", "cid"], "left")
    return j.select(F.explode(F.coalesce("tokens", F.array("token"))).alias("token"), "n").groupBy("token").agg(
        F.sum("n").alias("n"))


def roll_up(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Events and persons of every node of the tree: ``(system, level, node, parent, n_events, n_persons)``.

    Events are first counted per (person, concept), so an exchange carries one row for each of
    them and level; a node that covers most persons is a sum over partial sums.
    """
    each = events.groupBy("person_id", "et", "cid").agg(F.count(F.lit(1)).alias("n"))
    pieces = codes.repartition("et", "cid").withColumn("_pieces", code_pieces("system", "code"))  # taken apart once a code
    coded = cut_lineage(pieces.select("et", "cid", "system", F.explode(node_path(F.col("_pieces"))).alias("p")).select(
        "et", "cid", "system", "p.*"))
    key = ["system", "level", "node", "parent"]
    tree = cut_lineage(coded.select(*key).distinct().withColumn("_node", F.monotonically_increasing_id()))  # numbers, not names, cross the exchanges
    same = None
    for c in key:
        same = coded[c].eqNullSafe(tree[c]) if same is None else same & coded[c].eqNullSafe(tree[c])
    paths = cut_lineage(coded.join(tree, same).select("et", "cid", "_node").groupBy("et", "cid").agg(
        F.collect_list("_node").alias("_nodes")))
    nodes = each.join(paths, ["et", "cid"]).select("person_id", "n", F.explode("_nodes").alias("_node"))
    per = nodes.groupBy("_node", "person_id").agg(F.sum("n").alias("n"))
    total = per.groupBy("_node").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_persons"))
    return tree.join(total, "_node").select(*key, "n_events", "n_persons")
