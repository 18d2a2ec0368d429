"""Quadratic forms over GF(2), x'Ax + b'x + c, on the bits of masks. A is sparse; its rows are bitboards.

A form is a table of rows of A: for a bit i, words of 32 bits of the mask that its entries fall into. Its value is the parity of the entries whose
two bits are both set: for each of those rows one AND with the mask's word, one count of bits, and the bit i itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import left, right, total


def _one(i: Column) -> Column:
    return left(F.lit(1).cast("bigint"), i % 32)


def quadratic_forms(entries: DataFrame, linear: DataFrame, constants: DataFrame) -> DataFrame:
    """(form, a, b, c), a row for each form of ``constants`` (form, c). ``entries`` (form, i, j) are those of A that are odd (one that is there
    twice cancels), ``linear`` (form, i) those of b. ``a``: array of (i, word, bits); ``b``: array of (word, bits)."""
    word = lambda c: F.floor(F.col(c) / 32).cast("int")
    rows = entries.groupBy("form", "i", word("j").alias("word")).agg(F.bit_xor(_one(F.col("j"))).alias("bits")).where("bits <> 0")
    a = rows.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("i", "word", "bits"))).alias("a"))
    line = linear.groupBy("form", word("i").alias("word")).agg(F.bit_xor(_one(F.col("i"))).alias("bits")).where("bits <> 0")
    b = line.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("b"))
    full = constants.join(a, "form", "left").join(b, "form", "left")
    return full.select("form", F.coalesce("a", F.array().cast(a.schema["a"].dataType)).alias("a"), F.coalesce("b", F.array().cast(b.schema["b"].dataType)).alias("b"), F.pmod(F.col("c"), F.lit(2)).cast("bigint").alias("c"))


def value(mask: Column, a: Column, b: Column, c: Column) -> Column:
    """The form's value, 0 or 1, for a mask of 32 words; a null mask has none."""
    word = lambda w: F.get(mask, w)
    quadratic = total(F.transform(a, lambda e: right(word(F.floor(e["i"] / 32).cast("int")), e["i"] % 32).bitwiseAND(F.bit_count(word(e["word"]).bitwiseAND(e["bits"]))).bitwiseAND(F.lit(1)).cast("bigint")))
    line = total(F.transform(b, lambda e: F.bit_count(word(e["word"]).bitwiseAND(e["bits"])).cast("bigint")))
    return F.when(mask.isNotNull(), F.pmod(quadratic + line + c, F.lit(2)).cast("int"))


def form_values(masks: DataFrame, forms: DataFrame, column: str = "m", limit: int = 64 << 20) -> DataFrame:
    """``masks`` with each form's ``form`` and ``value``. The forms are sent to the rows if all are under ``limit`` bytes, which is checked;
    larger ones are an error, as each would be as large as the masks: give them in parts."""
    size = forms.agg(F.sum(F.size("a") * 24 + F.size("b") * 16 + 24)).first()[0] or 0
    if size > limit:
        raise ValueError(f"the forms have {size} bytes, more than {limit}")
    own = masks.crossJoin(F.broadcast(forms))
    return own.withColumn("value", value(F.col(column), F.col("a"), F.col("b"), F.col("c"))).drop("a", "b", "c")
