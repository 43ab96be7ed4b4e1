"""Three-way merge of two branches of a table of texts by operational transformation.

A branch is what it does to the base, not a copy of it. For each row it keeps or deletes it, and gives new values of columns; for the lines of a row's
text it has operations over the base's line numbers: retain, delete, replace and insert (of lines after that line; number -1 is the place before the
first). A row holds them as an array with a place a line, which operations() makes from a flat table of (at, kind, value) or a caller makes in
place; what isn't named is retained.

merge() transforms the two branches' operations against each other line by line: both refer to the base's numbers, so an insertion on one side
moves nothing on the other, and for each line and each gap after one there is one pair to settle. What one side alone does, or both do alike, is
taken and counts as clean; otherwise the later branch's state is taken, and it counts as a conflict of its kind: edit against edit, edit against
delete, or two insertions. What is settled is again one sequence of operations, and that is composed onto the base's lines. A deleted row counts alone.

All of it happens within the row: a table that has both branches' operations is merged without a shuffle, and no group is ever formed over more than
one row's own operations. Rows that share an id are merged each by itself; a row that a branch adds is a row of its own even where the base has its
id. Nulls in base columns, text and id count as empty where operations are made from them; an empty text is one empty line, and a text whose lines
all go is the empty text. An empty table gives an empty result; only the columns named are read, whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

RETAIN, DELETE, REPLACE, INSERT = "retain", "delete", "replace", "insert"
#: An operation as a row of a table has it, and what a branch does at a base line and in the gap after it.
OPERATION, PLACE = "struct<at:int,kind:string,value:string>", StructType([StructField(c, StringType()) for c in ("kind", "value", "insert")])
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def operations(base: DataFrame, flat: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """base with a column `name` of the operations that flat (id_col, at, kind, value) has for each row, in the form of by_line(). A group is one
    row's own operations; an operation of an id that base lacks, or of a line that the text lacks, says nothing."""
    each = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "kind", "value"))).alias(name))
    lines = F.size(F.split(F.coalesce(text_col, F.lit("")), "\n"))
    return base.join(each, id_col, "left").withColumn(name, by_line(F.coalesce(F.col(name), F.array().cast(f"array<{OPERATION}>")), lines))


@F.pandas_udf(ArrayType(PLACE))
def by_line(ops: pd.Series, lines: pd.Series) -> pd.Series:
    """Operations with a place for each base line and one before the first: (kind, value) of the line and what is inserted after it. Of
    several changes of one line the last counts; several insertions after one are lines in their order."""

    def one(ops, n):
        places = [{"kind": RETAIN, "value": None, "insert": None} for _ in range(n + 1)]
        for o in ops:
            if not -1 <= o["at"] < n:
                continue
            p = places[o["at"] + 1]
            if o["kind"] == INSERT:
                p["insert"] = o["value"] if p["insert"] is None else f"{p['insert']}\n{o['value']}"
            elif o["kind"] != RETAIN and o["at"] >= 0:
                p["kind"], p["value"] = o["kind"], o["value"] if o["kind"] == REPLACE else None
        return places

    return pd.Series([one(o, n) for o, n in zip(ops, lines, strict=True)])


def transformed(left: Column, right: Column) -> Column:
    """One array of settled operations from two of by_line's form: (kind, value, insert) and what each place counts as."""

    def settle(a, b):
        a_line, b_line = a["kind"] != RETAIN, b["kind"] != RETAIN
        line_same = (a["kind"] == b["kind"]) & a["value"].eqNullSafe(b["value"])
        a_gap, b_gap = a["insert"].isNotNull(), b["insert"].isNotNull()
        gap_clash = a_gap & b_gap & (a["insert"] != b["insert"])
        line_clash = a_line & b_line & ~line_same
        both_edit = (a["kind"] == REPLACE) & (b["kind"] == REPLACE)
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(b_line, b["kind"]).otherwise(a["kind"]).alias("kind"),
            F.when(b_line, b["value"]).otherwise(a["value"]).alias("value"),
            F.coalesce(b["insert"], a["insert"]).alias("insert"),
            (one((a_line | b_line) & ~line_clash) + one((a_gap | b_gap) & ~gap_clash)).alias("n_clean"),
            one(line_clash & both_edit).alias("n_edit_edit"),
            one(line_clash & ~both_edit).alias("n_edit_delete"),
            one(gap_clash).alias("n_insert_insert"),
        )

    return F.zip_with(left, right, settle)


def composed(lines: Column, settled: Column) -> Column:
    """The text that operations in by_line's form make of the base's lines; empty if no line is left."""
    whole = F.concat(F.array(F.lit("")), lines)  # the place before the first line has none

    def pieces(op, line, first):
        own = F.when(first | (op["kind"] == DELETE), F.lit(None).cast("string")).when(op["kind"] == REPLACE, op["value"]).otherwise(line)
        return F.array(own, op["insert"])

    parts = F.transform(settled, lambda op, i: pieces(op, whole[i], i == 0))
    return F.array_join(F.flatten(parts), "\n")  # which leaves nulls out


def changes_anything(ops: Column) -> Column:
    return F.exists(ops, lambda o: (o["kind"] != RETAIN) | o["insert"].isNotNull())


def merge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(id_col, columns, text_col, present, counts) of every row of the base and of every row that a branch adds.

    df has the base's columns and, for each branch, a struct `left` and `right`: deletes (boolean), columns (struct of new values, by name), lines (what
    by_line() makes) and adds (array of structs of id, columns and text; each id once). The right branch is the later one.
    """
    base = df.select(F.col(id_col).alias("id"), *(F.coalesce(c, F.lit("")).alias(f"was_{k}") for k, c in enumerate(columns)), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("lines"), "left", "right")
    base = base.withColumn("settled", transformed(F.col("left.lines"), F.col("right.lines")))
    gone, kept_by_one = F.col("left.deletes") | F.col("right.deletes"), F.col("left.deletes") != F.col("right.deletes")
    rows = base.select("id", "lines", "left", "right", "settled", *(f"was_{k}" for k in range(len(columns))), gone.alias("gone"), kept_by_one.alias("one_keeps"))
    value = lambda side, k: F.col(f"{side}.columns.{columns[k]}")
    changed = lambda side, k: ~value(side, k).eqNullSafe(F.col(f"was_{k}"))
    touched = lambda side: F.exists(F.array(F.lit(False), *(changed(side, k) for k in range(len(columns)))), lambda x: x) | changes_anything(F.col(f"{side}.lines"))
    keeper_touched = F.when(F.col("left.deletes"), touched("right")).otherwise(touched("left"))
    rows = rows.withColumn("dispute", F.col("one_keeps") & keeper_touched)
    #: A disputed row is as the right branch has it; other rows that are gone are gone.
    present = ~F.col("gone") | (F.col("dispute") & ~F.col("right.deletes"))
    one = lambda c: F.when(c, 1).otherwise(0)
    total = lambda name: F.aggregate("settled", F.lit(0), lambda n, x: n + x[name])
    clean = [one((changed("left", k) | changed("right", k)) & ~_clash(value, changed, k)) for k in range(len(columns))]
    edits = [one(_clash(value, changed, k)) for k in range(len(columns))]
    counts = {
        "n_clean": F.when(F.col("gone"), one(~F.col("dispute"))).otherwise(sum(clean, total("n_clean"))),
        "n_edit_edit": F.when(F.col("gone"), 0).otherwise(sum(edits, total("n_edit_edit"))),
        "n_edit_delete": F.when(F.col("gone"), one(F.col("dispute"))).otherwise(total("n_edit_delete")),
        "n_insert_insert": F.when(F.col("gone"), 0).otherwise(total("n_insert_insert")),
    }
    column = lambda k: F.when(F.col("gone"), value("right", k)).otherwise(F.when(changed("right", k), value("right", k)).otherwise(value("left", k)))
    text = F.when(F.col("gone"), composed(F.col("lines"), F.col("right.lines"))).otherwise(composed(F.col("lines"), F.col("settled")))
    own = F.struct(F.col("id").alias(id_col), *(F.when(present, column(k)).alias(c) for k, c in enumerate(columns)), F.when(present, text).alias(text_col), present.alias("present"), *(counts[c].cast("long").alias(c) for c in COUNTS))
    added = _added(id_col, text_col, columns)
    return rows.select(F.inline(F.concat(F.array(own), added)))


def _clash(value, changed, k: int) -> Column:
    return changed("left", k) & changed("right", k) & ~value("left", k).eqNullSafe(value("right", k))


def _added(id_col: str, text_col: str, columns: Sequence[str]) -> Column:
    """Rows that branches add: those of the right one, and those of the left one whose id the right one doesn't add."""
    parts = (id_col, *columns, text_col)

    def row(r, other_has, same):
        clean = F.when(other_has & ~same, 0).otherwise(1).cast("long")
        zero = F.lit(0).cast("long")
        return F.struct(*(r[c].alias(c) for c in parts), F.lit(True).alias("present"), clean.alias("n_clean"), zero.alias("n_edit_edit"), zero.alias("n_edit_delete"), (1 - clean).alias("n_insert_insert"))

    same_id = lambda x, r: x[id_col].eqNullSafe(r[id_col])
    equal = lambda x, r: _all(x[c].eqNullSafe(r[c]) for c in parts)
    mine = F.transform(F.col("right.adds"), lambda r: row(r, F.exists(F.col("left.adds"), lambda x: same_id(x, r)), F.exists(F.col("left.adds"), lambda x: equal(x, r))))
    theirs = F.transform(F.filter(F.col("left.adds"), lambda r: ~F.exists(F.col("right.adds"), lambda x: same_id(x, r))), lambda r: row(r, F.lit(False), F.lit(False)))
    return F.concat(mine, theirs)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
