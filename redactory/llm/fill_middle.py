"""Fill-in-the-middle transformation of whole texts by bit-parallel arithmetic on big integers.

Method. A text's UTF-8 bytes are translated into class masks, a byte of 0 or 1 for each byte
of the text, and each mask is read as one integer. Shifting the mask of line ends by a byte and
joining it with the first place marks where lines begin; its ``bit_count`` is the
number of lines, and the place of the ``k``-th line is found by halving the mask again
and again, going on in the half that holds the wanted bit. All steps are a few passes over
machine words, none over characters.

A line is ``[^\\n]*\\n|[^\\n]+``. Two cuts between lines, fixed by the row's id and a seed, part
a text into prefix, middle and suffix, which are put in the order of one of two forms:
``psm`` is ``<P>prefix<S>suffix<M>middle`` and ``spm`` is ``<S>suffix<P>prefix<M>middle``. Texts that
are ``plain`` stay as they are. :func:`restore` gives the text back from output and form alone: as the
marks' first character stands nowhere else in them, the first of each kind is always the one that was put there.

Defined results: a null text is an empty one; empty texts and texts that hold a mark
are plain, without lengths of parts; a null id counts as an id without digits; repeated rows
have equal results; an empty table gives an empty table; all columns are kept, except one of the name ``out``,
which is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LINE_END = bytes(b == 0x0A for b in range(256))
_CHARACTER = bytes(b & 0xC0 != 0x80 for b in range(256))


def mask(text: bytes, kind: bytes) -> int:
    """Bit ``8 * i`` says whether byte ``i`` is of the class."""
    return int.from_bytes(text.translate(kind), "little")


def low(bits: int, n: int) -> int:
    """The ``n`` lowest bits."""
    return bits & ((1 << n) - 1)


def line_starts(text: bytes) -> int:
    """Bit ``8 * i`` says whether a line begins at byte ``i``."""
    return low((mask(text, _LINE_END) << 8) | 1, 8 * len(text))


def select(bits: int, rank: int, width: int | None = None) -> int:
    """Place of the set bit before which ``rank`` others are set."""
    width = bits.bit_length() if width is None else width
    if width <= 1:
        return 0
    half = width >> 1
    lower = low(bits, half)
    below = lower.bit_count()
    return select(lower, rank, half) if rank < below else half + select(bits >> half, rank - below, width - half)


def split(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """Number of lines ``n``, and the bytes at which prefix and middle end: after ``first`` and ``second`` modulo ``n + 1`` lines, the smaller first."""
    starts = line_starts(text)
    n = starts.bit_count()
    ends = [len(text) if k == n else select(starts, k) >> 3 for k in sorted((first % (n + 1), second % (n + 1)))]
    return n, *ends


def characters(text: bytes, *ends: int) -> list[int]:
    """Code points before each of the ``ends``."""
    every = mask(text, _CHARACTER)
    return [low(every, 8 * end).bit_count() for end in ends]


def transformed(text: bytes, row_id: str, seed: int, rate: int, spm: int) -> dict:
    digest = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    first, second, chosen, form = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n, a, b = split(text, first, second)
    if not text or chosen % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    before, until = characters(text, a, b)
    if form % 100 < spm:
        name, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        name, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return {"n": n, "form": name, "prefix_chars": before, "middle_chars": until - before, "output": b"".join(parts)}


_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with a column ``out``: ``struct<n long, form string, prefix_chars long, middle_chars long, output string>``.

    ``rate`` percent of the texts are transformed, of these ``spm`` percent to the form ``spm``.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: binary>")
    def done(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in batches:
            rows = [transformed(t.as_py(), i.as_py(), seed, rate, spm) for t, i in zip(texts, ids, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS], [name for name, _ in _FIELDS])

    made = done(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return docs.withColumn(out, made.withField("output", made["output"].cast("string")))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
