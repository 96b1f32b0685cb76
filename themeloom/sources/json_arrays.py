"""JSON-array files of any size, read by many tasks.

A file is cut at every closing brace, which a byte range of a file can do by itself.  Which of the
cuts end an element follows from running sums over the fragments: of quotes (odd: the cut lies in a
string), of brackets outside strings (one level is left: an element ends), and of the ends before
(the number of the element).  Only the totals of a file's byte ranges meet in one place; the
fragments of an element are put together by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.joins import running_total
from themeloom.session import materialize

# States of a row.
OBJECT, OTHER, CORRUPT, NO_ARRAY = "object", "other", "corrupt", "no_array"


def _count(text: Column, signs: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{signs}]", ""))


def _path(name: str) -> Column:
    """A file's name; lists and scans write its scheme differently."""
    return F.regexp_replace(name, "^([a-z0-9]+):/+", "$1:/").alias("path")


def _fragments(files: DataFrame) -> DataFrame:
    """(path, length, block, id, value, ends, element) for every piece before a brace.

    ``ends`` tells whether the brace ends an element; ``element`` counts the ends before it;
    ``length`` is the file's.
    """
    raw = files.select(
        _path("_metadata.file_path"), F.col("_metadata.file_size").alias("length"),
        # as text in the order of numbers: a file has few byte ranges, which need no levels
        F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped signs
    odd = _count(plain, '"') % 2

    def step(begin: str) -> Column:
        """Change of the level, the brace behind the piece included, for each kind of beginning."""
        outside = F.regexp_replace(F.concat(F.lit(begin), plain), r'"[^"]*("|$)', "")
        return (_count(outside, r"\[{") - _count(outside, r"\]}")
                - F.when(odd == len(begin), 1).otherwise(0))

    # written once with both steps: the sums read narrow columns only
    raw = materialize(raw.select("*", odd.alias("odd"), step("").alias("out"),
                                 step('"').alias("in")))
    within = running_total(raw, ["path"], "block", [F.col("id")], F.col("odd"), "before",
                           inclusive=False)
    inside = F.col("before") % 2 == 1
    steps = within.select("path", "length", "block", "id", "value",
                          ((F.col("before") + F.col("odd")) % 2 == 0).alias("cut"),
                          F.when(inside, F.col("in")).otherwise(F.col("out")).alias("step"))
    levels = running_total(steps, ["path"], "block", [F.col("id")], F.col("step"), "level")
    ends = levels.select("path", "length", "block", "id", "value",
                         (F.col("cut") & (F.col("level") == 1)).alias("ends"))
    return running_total(ends, ["path"], "block", [F.col("id")], F.col("ends").cast("int"),
                         "element", inclusive=False)


def read_arrays(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, position, value, state) of every element of the arrays in a folder's files.

    ``value`` is an element's JSON text.  States: "object"; "other" for elements that are no
    objects, of which neighbours may share a row; "corrupt"; "no_array" for a file that holds
    another valid value.  A file that is no array has one row without a position, as has an array
    whose end is missing and an empty file.  An empty array has no row.  Elements after a corrupt
    one aren't told apart reliably.
    """
    # the folder is listed once, however many files it has
    listed = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).text(folder)
    # a scan leaves empty files out, the list that it was planned with doesn't
    files = spark.createDataFrame([(name,) for name in listed.inputFiles()], "path string").select(
        _path("path"))
    fragments = materialize(_fragments(listed))
    piece = F.struct("block", "id", "value")

    def joined(pieces: str) -> Column:
        return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["value"]), "}")

    groups = fragments.groupBy("path", "element").agg(
        F.collect_list(piece).alias("pieces"), F.bool_or("ends").alias("whole")).select(
            "path", "element", "whole", joined("pieces").alias("text"))
    # what a file begins with, and whether its last piece ends in a brace
    about = fragments.groupBy("path").agg(
        F.min_by("value", F.struct("block", "id")).alias("first"),
        F.max_by("ends", F.struct("block", "id")).alias("open"),
        (F.sum(F.octet_length("value")) + F.count(F.lit(1))).alias("bytes"),
        F.max("length").alias("length"))
    about = files.join(about, "path", "left").select(
        "path", F.coalesce(F.col("first").rlike(r"^\s*\["), F.lit(False)).alias("is_array"),
        F.coalesce("open", F.lit(True)).alias("open"),
        F.when(F.col("length") == F.col("bytes"), "}").otherwise("").alias("brace"))

    lead = F.when(F.col("element") == 0, r"^\s*\[").otherwise(r"^\s*,")
    body = F.regexp_replace("text", lead, "")
    led = F.regexp_like("text", lead)
    tail = ~F.col("whole")
    closing = F.col("text").rlike(r"^\s*\]\s*$") & (F.col("element") > 0) | (
        F.col("text").rlike(r"^\s*\[\s*\]\s*$") & (F.col("element") == 0))
    element = F.when(tail, F.concat(F.lit("["), body)).otherwise(
        F.concat(F.lit("["), body, F.lit("}]")))
    n = F.json_array_length(element)
    state = (F.when(~led | n.isNull() | (n == 0) | (tail & ~F.col("text").rlike(r"\]\s*$")),
                    CORRUPT)
             .when(tail | (n > 1) | ~body.rlike(r"^\s*\{"), OTHER).otherwise(OBJECT))
    inside = groups.join(about.filter("is_array").select("path"), "path").filter(
        ~(tail & closing)).select(
            "path", F.col("element").cast("int").alias("position"),
            F.when(tail, body).otherwise(F.concat(F.trim(body), F.lit("}"))).alias("value"),
            state.alias("state"))
    unfinished = about.filter("is_array AND open").select("path", F.lit(CORRUPT).alias("state"))
    others = about.filter(~F.col("is_array")).join(
        fragments.groupBy("path").agg(F.collect_list(piece).alias("pieces")), "path", "left")
    valid = F.try_parse_json(F.concat(joined("pieces"), F.col("brace"))).isNotNull()
    others = others.select("path", F.when(valid, NO_ARRAY).otherwise(CORRUPT).alias("state"))
    files_only = unfinished.union(others).select(
        "path", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias(
            "value"), "state")
    return inside.unionByName(files_only)
