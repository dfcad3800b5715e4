"""Nucleotides as letters, 2-bit codes and packed words.

All functions take and return columns, and stay inside the engine's generated code where it has any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: Projection of a-z onto the four letters, in turn, for texts that are no DNA.
A_TO_Z = "abcdefghijklmnopqrstuvwxyz"
CYCLE = (LETTERS * 7)[: len(A_TO_Z)]


def project_text(text: Column) -> Column:
    """The ASCII letters of a text as nucleotides."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]+", "")), A_TO_Z, CYCLE)


def clean(sequence: Column) -> Column:
    """Anything but A, C, G and T becomes A."""
    return F.regexp_replace(sequence, "[^ACGT]", "A")


def codes(sequence: Column) -> Column:
    """One digit 0 to 3 for each letter; any other character is 0."""
    return F.translate(clean(sequence), LETTERS, "0123")


def letters(digits: Column) -> Column:
    return F.translate(digits, "0123", LETTERS)


def code_of(letter: Column) -> Column:
    return F.greatest(F.instr(F.lit(LETTERS), letter) - 1, F.lit(0))


def letter_of(code: Column) -> Column:
    return F.substring(F.lit(LETTERS), code + 1, F.lit(1))


def pack(sequence: Column) -> Column:
    """Up to 32 letters in one long, the first in the two lowest bits."""
    return pack_letters(clean(sequence))


def pack_letters(sequence: Column) -> Column:
    """pack() for sequences known to be clean."""
    return F.conv(F.translate(F.reverse(sequence), LETTERS, "0123"), 4, -10).cast("bigint")


def unpack(word: Column, n: Column | int) -> Column:
    """The first n letters of a packed word."""
    digits = F.lpad(F.conv(F.hex(word), 16, 4), 32, "0")  # of no sign: conv takes -2 ** 63 for too large a number
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(F.reverse(F.translate(digits, "0123", LETTERS)), F.lit(1), n)


def pack_words(sequence: Column) -> Column:
    """All letters, 32 in each long."""
    last = F.ceil(F.length(sequence) / 32).cast("int") - 1
    return F.when(F.length(sequence) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: pack(F.substring(sequence, i * 32 + 1, F.lit(32))))).otherwise(
        F.array().cast("array<bigint>")
    )


def unpack_words(words: Column, n: Column) -> Column:
    return F.substring(F.array_join(F.transform(words, lambda w: unpack(w, 32)), ""), F.lit(1), n)


def popcount(word: Column) -> Column:
    return F.bit_count(word)


def get_bit(word: Column, at: Column) -> Column:
    return F.getbit(word, at)


def set_bit(word: Column, at: Column, on: Column) -> Column:
    """word, or-ed with the bit where on is true; bits are counted from the lowest."""
    return F.when(on, word.bitwiseOR(shift_left(F.lit(1).cast("bigint"), at))).otherwise(word)


def shift_left(word: Column, by: Column) -> Column:
    """Shift that gives 0 from 64 on, where the engine's own counts modulo 64."""
    return F.when(by >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", word, by.cast("int")))


def low_bits(n: Column) -> Column:
    """A mask of the n lowest bits, all 64 from 64 on."""
    return F.when(n >= 64, F.lit(-1).cast("bigint")).when(n == 63, F.lit((1 << 63) - 1)).otherwise(shift_left(F.lit(1).cast("bigint"), n) - 1)


def copy_range(target: Column, source: Column, begin: Column, size: Column, at: Column) -> Column:
    """target with size characters (letters, or bits written as 0 and 1) of source from begin put in at `at`."""
    return F.concat(
        F.substring(target, F.lit(1), at), F.substring(source, begin + 1, size), F.substring(target, at + size + 1, F.length(target))
    )


def mod(a: Column, b: Column) -> Column:
    return F.pmod(a, b)


def ceil_div(a: Column, b: Column) -> Column:
    """The least whole number that is not below a / b, in whole numbers throughout."""
    whole, rest = F.call_function("div", a, b), a % b
    return whole + F.when((rest != 0) & ((rest > 0) == (b > 0)), 1).otherwise(0)


def ceil_multiple(a: Column, b: Column) -> Column:
    return ceil_div(a, b) * b


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves at least 1 of the number in single precision; three decimals beyond bytes."""
    out, single = F.concat(n.cast("string"), F.lit(" B")), (n.cast("float") * F.lit(1).cast("float")).cast("double")
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        scaled = single / 1024**i  # the product above keeps the engine from dropping the cast to single precision
        out = F.when(scaled >= 1, F.concat(F.format_string("%.3f", F.bround(scaled, 3)), F.lit(" " + unit))).otherwise(out)
    return out


def lane5(word: Column, lane: Column) -> Column:
    """The lane-th group of 5 bits from the lowest."""
    return F.call_function("shiftrightunsigned", word, (lane * 5).cast("int")).bitwiseAND(F.lit(31))


def skip_value(offset: Column) -> Column:
    """A skip distance of 5 bits of exponent and, above them, 7 bits of mantissa."""
    exponent = offset.bitwiseAND(F.lit(31)).cast("int")
    mantissa = F.call_function("shiftrightunsigned", offset, F.lit(5)).bitwiseAND(F.lit(127)).cast("bigint")
    return F.call_function("shiftleft", mantissa, exponent)


def invalid_runs(sequence: Column) -> Column:
    """(start, length) of each run of characters other than A, C, G and T."""
    runs = F.arrays_zip(F.split(sequence, "[^ACGT]+").alias("good"), F.regexp_extract_all(sequence, F.lit("[^ACGT]+"), F.lit(0)).alias("bad"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["good"]) + F.length(x["bad"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["good"])).alias("start"), F.length(x["bad"]).alias("length")))).alias("out"),
    )
    empty = F.array().cast("array<struct<start:int,length:int>>")
    found = F.filter(runs, lambda x: x["bad"].isNotNull())
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def is_header(line: Column) -> Column:
    return F.left(line, F.lit(1)).isin("@", ">")


def is_marker(line: Column) -> Column:
    return F.left(line, F.lit(1)) == "+"


def is_valid(sequence: Column) -> Column:
    return ~sequence.rlike("[^ACGT]")
