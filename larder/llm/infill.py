"""Fill-in-the-middle: cuts at ranks of units, looked up in the sparse events of one Aho-Corasick scan."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Characters at which the class of a text changes, and the marks before prefix, suffix and middle.
BLANKS, PREFIX, SUFFIX, MIDDLE = " \t\n\v\f\r", "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """One automaton for blanks (0) and marks (1)."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word in BLANKS:
        found.add_word(word, 0)
    for word in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(word, 1)
    found.make_automaton()
    return found


def events(text: str) -> tuple[np.ndarray, bool]:
    """Code points of all blanks of a text, and whether a mark stands in it."""
    flat = np.fromiter(chain.from_iterable(_automaton().iter(text)), np.int64)
    at, kind = flat[::2], flat[1::2]
    return at[kind == 0], bool(kind.any())


def unit_ends(blanks: np.ndarray, length: int) -> np.ndarray:
    """Where each unit (blanks with the word after them, or blanks at the end) of a text ends.

    A gap between neighbouring blanks holds one word if it is not empty, so that the units up to any
    place are counted by the gaps alone.

    >>> unit_ends(np.array([0, 3, 4, 7]), 8).tolist()  # " ab  cd "
    [3, 7, 8]
    """
    edges = np.concatenate(([-1], blanks, [length]))
    ends = edges[1:][np.diff(edges) > 1]
    return np.append(ends, length) if len(blanks) and blanks[-1] == length - 1 else ends


def cut(text: str, h: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text under its four draws."""
    blanks, marked = events(text)
    ends = unit_ends(blanks, len(text))
    n = len(ends)
    if not text or marked or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(ends[u - 1]) if u else 0 for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """Rearrange ``rate`` per cent of the texts for infilling: doc_id, n, form, prefix_chars, middle_chars, output.

    The draws are the first four 32-bit groups of sha256("seed:doc_id"), so that they are the same in
    every run and task.  One pass, no shuffle; a task holds some megabytes of text, or one text.

    A null text is empty; an empty text, and one that holds a mark, stays plain; the draws of a null
    doc_id are those of an empty id; repeated rows are treated alike, once each; an empty table gives
    an empty result; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, texts, *draws = batch.columns
            draws = zip(*(d.to_pylist() for d in draws))
            n, form, before, middle, output = zip(*(cut(t or "", h, rate, suffix_first) for t, h in zip(texts.to_pylist(), draws)))
            columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  Marks are not in cut texts and overlap nothing, so each stands once."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir)).withColumn("output_sha256", F.sha2("output", 256))
    return found.withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256)).drop("output")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS u2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS rate, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS side FROM cut),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= 50 THEN 'plain'
                 WHEN side < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:least(u1, u2)], '') AS pre, array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS mid,
         array_to_string(units[greatest(u1, u2) + 1:], '') AS suf FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM pieces
"""
