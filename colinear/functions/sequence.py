"""Native column functions on sequences: strands, codes, frames, composition and identity."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes, the bases that each stands for, and their complements.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "K": "GT", "M": "AC", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "B": "CGT", "V": "ACG", "H": "ACT", "D": "AGT", "N": "ACGT", "X": "ACGT", "-": "",
}
CODES, COMPLEMENTS = "ACGTKMRYSWBVHDNX", "TGCAMKYRSWVBDHNX"
# The standard genetic code, codons in the order TCAG of each position.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: The letters of any text read as nucleotides, in turn.
FOLD_FROM, FOLD_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: What every byte of a text is folded to, 0 if it is left out; the only other characters that are letters a-z in lower case.
FOLD_BYTE = np.zeros(256, np.uint8)
for _a, _b in zip(FOLD_FROM, FOLD_TO, strict=True):
    FOLD_BYTE[ord(_a)] = FOLD_BYTE[ord(_a.upper())] = ord(_b)
LOWER_ASCII = {"\u0130": "i", "\u212a": "k"}
FOLD_TABLE, LEFT_OUT = FOLD_BYTE.tobytes(), np.flatnonzero(FOLD_BYTE == 0).astype(np.uint8).tobytes()
#: Amino acids in the order of their codes.
PROTEIN = "ARNDCQEGHILKMFPSTWYV*"


def fold(text: Column) -> Column:
    """A text read as a nucleotide sequence: its letters a-z in turn ACGT, the rest left out."""
    return F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), "[^ACGT]", "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings in a row, and where each string begins in them (and the last one ends)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, kind)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def characters(texts: pa.Array) -> pa.Array:
    """An Arrow array of strings with a byte for each character: of those beyond ASCII the first one stays, as places count characters. The bytes are no text any more where there are such."""
    held, at = flat(texts)
    if not len(held) or held.max() < 128:
        return texts
    kept = (held & 0xC0) != 0x80
    return _packed(texts, held[kept], np.concatenate([[0], np.cumsum(kept, dtype=at.dtype)]).astype(at.dtype)[at])


def _packed(texts: pa.Array, held: np.ndarray, at: np.ndarray) -> pa.Array:
    kind = pa.LargeStringArray if at.dtype == np.int64 else pa.StringArray
    return kind.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(held), texts.is_valid().buffers()[1] if texts.null_count else None)


def folded(texts: pa.Array) -> pa.Array:
    """``fold`` of an Arrow array of texts, all of them at once."""
    for c, plain in LOWER_ASCII.items():
        if pc.any(pc.match_substring(texts, c)).as_py():
            texts = pc.replace_substring(texts, c, plain)
    held, at = flat(texts)
    parts = [held[a:b].tobytes().translate(FOLD_TABLE, LEFT_OUT) for a, b in pairwise(at.tolist())]
    return _packed(texts, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]).astype(at.dtype))


def complement(seq: Column) -> Column:
    return F.translate(seq, CODES, COMPLEMENTS)


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters that are no code stay."""
    return F.reverse(complement(seq))


def slice_clamped(seq: Column, start: Column, length: Column) -> Column:
    """``length`` letters from ``start`` (0-based); what lies outside the sequence is left out."""
    a = F.greatest(start, F.lit(0))
    b = F.least(start + length, F.length(seq))
    return F.when(b > a, F.substring(seq, (a + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))


def remove_gaps(seq: Column) -> Column:
    return F.translate(seq, "-.", "")


def count_of(seq: Column, letters: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def n_count(seq: Column) -> Column:
    """Ns and Xs."""
    return count_of(seq, "NX")


def gc_content(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.when(F.length(seq) > 0, count_of(seq, "GC") / F.length(seq))


def homopolymer(seq: Column, least: float) -> Column:
    """Whether one base makes up at least the share ``least``."""
    most = F.greatest(*[count_of(seq, b) for b in "ACGT"])
    return (F.length(seq) > 0) & (most >= F.length(seq) * F.lit(least))


def low_complexity(seq: Column) -> Column:
    """All letters are the same."""
    return seq.rlike(r"^(.)\1*$")


def soft_masked(seq: Column, every: int = 4) -> Column:
    """At least half of every 4th letter is in lower case."""
    picked = F.filter(F.split(seq, ""), lambda x, i: (i % every == 0) & (x != ""))
    return F.size(F.filter(picked, lambda x: x != F.upper(x))) * 2 >= F.size(picked)


def weight(code: Column, base: str) -> Column:
    """The share of a base in a code: K is half G, half T."""
    out = F.lit(0.0)
    for c, bases in IUPAC.items():
        if base in bases:
            out = F.when(code == c, F.lit(1.0 / len(bases))).otherwise(out)
    return out


def equal(a: Column, b: Column) -> Column:
    """Probability that two codes stand for the same base."""
    return sum((weight(a, x) * weight(b, x) for x in "CGT"), weight(a, "A") * weight(b, "A"))


def equal_ambiguous(a: Column, b: Column) -> Column:
    """1 for one and the same code but N, else ``equal``."""
    return F.when((a == b) & ~a.isin("N", "X"), F.lit(1.0)).otherwise(equal(a, b))


def equal_emphasised(a: Column, b: Column) -> Column:
    e = equal(a, b)
    return F.when(e > 0.26, F.least(e + 0.2, F.lit(1.0))).otherwise(e)


def differ(a: Column, b: Column) -> Column:
    return F.lit(1.0) - equal(a, b)


def differ_ambiguous(a: Column, b: Column) -> Column:
    return F.lit(1.0) - equal_ambiguous(a, b)


#: Codes by the bits of their bases: A 1, C 2, G 4, T 8.
BY_BITS = ["-"] + [next(c for c, bases in IUPAC.items() if c != "X" and sum(1 << "ACGT".index(x) for x in bases) == bits) for bits in range(1, 16)]


def base_bits(code: Column) -> Column:
    out = F.lit(0)
    for c, bases in IUPAC.items():
        out = F.when(code == c, F.lit(sum(1 << "ACGT".index(x) for x in bases))).otherwise(out)
    return out


def ambiguity_code(bits: Column) -> Column:
    """The code for a set of bases given as bits (``base_bits``, joined by ``bit_or``)."""
    return F.element_at(F.array(*[F.lit(x) for x in BY_BITS]), bits.cast("int") + 1)


def resolve(a: Column, b: Column) -> Column:
    """Of two codes the plain base; the first if both or neither are."""
    plain = lambda x: x.isin("A", "C", "G", "T")
    return F.when(plain(a), a).when(plain(b), b).otherwise(a)


def nucleotide_index(code: Column) -> Column:
    """0 to 3 for A, C, G, T; -1 for others."""
    return F.position(code, F.lit("ACGT")) - 1


def amino_index(letter: Column) -> Column:
    """0 to 19 for the amino acids in the order of their letters; -1 for others."""
    return F.position(letter, F.lit("ACDEFGHIKLMNPQRSTVWY")) - 1


def column_distance(a: Column, b: Column) -> Column:
    """0 if two columns of letters (arrays) share any, else 1."""
    return F.when(F.arrays_overlap(a, b), 0).otherwise(1)


def likeliest_base(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The base of the greatest of four weights, the first of equals."""
    most = F.greatest(a, c, g, t)
    return F.when(a == most, "A").when(c == most, "C").when(g == most, "G").otherwise("T")


def codons(seq: Column) -> Column:
    """Array of the whole codons."""
    return F.regexp_extract_all(seq, F.lit("(.{3})"), F.lit(1))


def translate_codons(seq: Column, unknown: str = "Q") -> Column:
    """Amino acids of the whole codons; a codon with an ambiguous base gives ``unknown``."""
    code = F.lit(AMINO)

    place = lambda c, n: F.position(F.substring(c, n, 1), F.lit("TCAG")) - 1
    letter = lambda c: F.when((place(c, 1) < 0) | (place(c, 2) < 0) | (place(c, 3) < 0), F.lit(unknown)).otherwise(F.substr(code, place(c, 1) * 16 + place(c, 2) * 4 + place(c, 3) + 1, F.lit(1)))
    return F.array_join(F.transform(codons(seq), letter), "")


def frames(seq: Column) -> Column:
    """Array of (frame, seq): +1 to +3 and -1 to -3, cut to whole codons."""
    out = []
    for sign, s in ((1, seq), (-1, revcomp(seq))):
        for f in range(3):
            n = F.floor((F.length(s) - f) / 3) * 3
            out.append(F.struct(F.lit(sign * (f + 1)).alias("frame"), F.substring(s, F.lit(f + 1), F.greatest(n, F.lit(0)).cast("int")).alias("seq")))
    return F.array(*out)


def identity(a: Column, b: Column) -> Column:
    """Share of equal letters over the shorter of two sequences; null if that is empty."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n > 0, same / n)


def clean_name(name: Column) -> Column:
    """A sequence's name from its header: without ``>``, words joined by ``_``."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, "^>", "")), r"\s+", "_")


def gap_runs(seq: Column, letter: str = "N") -> Column:
    """Array of (start, end) of the maximal runs of a letter, 0-based, half-open."""
    runs = F.regexp_extract_all(seq, F.lit(f"({letter}+|[^{letter}]+)"), F.lit(1))
    spans = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found")),
        lambda s, r: F.struct((s["at"] + F.length(r)).alias("at"), F.when(r.startswith(letter), F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(r)).alias("end"))))).otherwise(s["found"]).alias("found")),
    )
    return spans["found"]


def consensus(letters: Column) -> Column:
    """The letter that an array holds, ``?`` if it holds several."""
    return F.when(F.size(F.array_distinct(letters)) > 1, F.lit("?")).otherwise(F.element_at(letters, 1))


def _codon_codes() -> dict[str, str]:
    """For each amino acid the three codes that its codons' bases make together."""
    order, bits = "TCAG", {}
    for i, amino in enumerate(AMINO):
        codon = order[i // 16] + order[i // 4 % 4] + order[i % 4]
        old = bits.setdefault(amino, [0, 0, 0])
        for k, c in enumerate(codon):
            old[k] |= 1 << "ACGT".index(c)
    return {a: "".join(BY_BITS[x] for x in b) for a, b in bits.items()}


def back_translate(protein: Column) -> Column:
    """The ambiguous nucleotide sequence of a protein; an unknown amino acid gives NNN."""
    codes = _codon_codes()
    table = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])
    letters = F.filter(F.split(F.upper(protein), ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.element_at(table, x), F.lit("NNN"))), "")


def substitution(a: Column, b: Column, scores: dict[tuple[str, str], float], unknown: float = -100.0) -> Column:
    """The score of a letter against another by a table of pairs (``tables.read_scores`` reads one, for amino acids or codons); ``unknown`` if it isn't there."""
    table = F.create_map(*[F.lit(v) for (x, y), n in sorted(scores.items()) for v in (x + y, float(n))])
    return F.coalesce(F.element_at(table, F.concat(F.upper(a), F.upper(b))), F.lit(float(unknown)))
