"""Fill-in-the-middle transformation of texts, with cuts at units: tokens, code points or lines.

A text's UTF-8 bytes are stored as maximal runs of characters of one class: whether
a unit can end in them, and their width in bytes. Each run holds the numbers of units
and code points before it. A cut at a unit is a binary search for the run that holds
it, and the place inside the run follows by arithmetic, in bytes and code points alike.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import added, table

#: Marks of the three parts; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are changed; of 100 of these, those with the suffix first.
RATE, SPM_RATE, SEED = 50, 80, 42
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of a code point by its first byte; 0 for the bytes that go on.
WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


@dataclass
class Runs:
    """Runs of one class, by the byte they start at (one more entry: the end), with the units and code points before each.

    ``each``: units that a character of the run completes (0 or 1); with 0 the run completes
    ``last`` units at its end.
    """

    starts: np.ndarray
    widths: np.ndarray
    points: np.ndarray
    units: np.ndarray
    each: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) behind so many units."""
        if not unit:
            return 0, 0
        k = int(np.searchsorted(self.units, unit)) - 1  # the run that completes it
        if not self.each[k]:
            return int(self.starts[k + 1]), int(self.points[k + 1])
        chars = unit - int(self.units[k])
        return int(self.starts[k]) + chars * int(self.widths[k]), int(self.points[k]) + chars


def runs(data: bytes, unit: str = "token") -> Runs:
    """The runs of a text in UTF-8. Units: ``token`` (blanks and the word behind them; blanks at the end), ``char`` (code points) or ``line`` (with its newline; what is left)."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(WIDTH[b])
    first = b[at]
    width = WIDTH[first]
    kind = {"token": BLANK[first], "line": first == 10, "char": np.zeros(len(at), bool)}[unit]
    key = width * 2 + kind
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    starts, widths, kinds = np.append(at[head], len(b)), width[head], kind[head]
    points = np.append(head, len(at))
    if unit == "char":
        each, ends = np.ones(len(head), bool), np.diff(points)
    elif unit == "line":
        each = kinds
        ends = np.where(kinds, np.diff(points), 0)
        if len(head) and not kinds[-1]:
            ends[-1] = 1
    else:  # a word ends where blanks follow, whatever the widths of its runs; blanks at the end are a token
        each = np.zeros(len(head), bool)
        ends = np.append(~kinds[:-1] & kinds[1:], True).astype(np.int64) if len(head) else np.zeros(0, np.int64)
    return Runs(starts, widths, points, np.append(0, np.cumsum(ends)), each)


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that the id alone decides (null: an empty one)."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(x[k : k + 8], 16) for k in range(0, 32, 8))


def infilled(text: str | None, doc_id: object, unit: str = "token", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text (null: empty)."""
    text = text or ""
    data = text.encode()
    cut = runs(data, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return cut.n, "plain", None, None, text
    low, high = sorted((h1 % (cut.n + 1), h2 % (cut.n + 1)))
    (a, a_points), (z, z_points) = cut.cut(low), cut.cut(high)
    prefix, middle, suffix = data[:a].decode(), data[a:z].decode(), data[z:].decode()
    if h4 % 100 < spm_rate:
        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return cut.n, form, a_points, z_points - a_points, out


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for. A mark can't arise where parts meet marks, so the first of each kind is the one that was set."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third, mark = F.instr(output, MIDDLE), len(PREFIX)
    one, two, middle = output.substr(F.lit(mark + 1), second - mark - 1), output.substr(second + mark, third - second - mark), output.substr(third + mark, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def infill(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "token", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and ``n, form, prefix_chars, middle_chars, output``; columns of these names are replaced.

    A document's own id decides its form and cuts (a null id counts as an empty one), so reruns and
    repeated rows agree. Null and empty texts are plain, with an empty output and no units.
    ``prefix_chars`` and ``middle_chars`` are null if plain. Whole texts, row by row: nothing is shuffled; an empty table stays empty.
    """

    def make(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        out = [infilled(t, i, unit, rate, spm_rate, seed) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
        return [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]

    return added(docs, "n long, form string, prefix_chars long, middle_chars long, output string", make, [id_col, text])


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = {
    "op11_infill": """
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as w, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
e as (select *, len(w) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as z from e),
g as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:z], '') as m, array_to_string(w[z + 1:], '') as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from g""",
}
