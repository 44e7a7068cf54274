"""Constants of known algorithms in code: a table of signatures, hints by counts of distinct constants, ordered S-box bytes.

A hint is no classification: shared initial values and single polynomials say little, and `strength` says which they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.code import let
from millrace.functions.text import literal_bits, numeric_literals


def _crc(polynomial: int) -> list[int]:
    """The byte table of a reflected 32-bit CRC, without its zero."""
    out = []
    for value in range(1, 256):
        for _ in range(8):
            value = value >> 1 ^ polynomial * (value & 1)
        out.append(value)
    return out


def _root(n: int, k: int) -> int:
    """The k-th root of n, rounded down."""
    low, high = 0, 1 << n.bit_length() // k + 1
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**k <= n else (low, mid)
    return low


def _fractions(count: int, k: int, bits: int) -> list[int]:
    """The first bits of the fractions of the k-th roots of the first primes."""
    primes = [p for p in range(2, 400) if all(p % d for d in range(2, math.isqrt(p) + 1))][:count]
    return [_root(p << bits * k, k) & (1 << bits) - 1 for p in primes]


def signatures() -> list[tuple[str, str, int, list[int]]]:
    """(signature, strength, least distinct constants, constants)."""
    weak, shared, many = "weak_single_constant", "ambiguous_shared_iv", "multi_constant"
    md5 = [int(abs(math.sin(i)) * 2**32) for i in range(1, 65)]
    # Fixed values of the algorithms' definitions, where no rule gives them.
    return [
        ("crc32_ieee_polynomial", weak, 1, [0xEDB88320, 0x04C11DB7]),
        ("crc32c_polynomial", weak, 1, [0x82F63B78, 0x1EDC6F41]),
        ("crc32_ieee_table_values", many, 4, _crc(0xEDB88320)),
        ("crc32c_table_values", many, 4, _crc(0x82F63B78)),
        ("sha256_round_k", many, 4, _fractions(64, 3, 32)),
        ("sha256_or_blake2s_iv", shared, 4, _fractions(8, 2, 32)),
        ("sha512_or_blake2b_iv", shared, 4, _fractions(8, 2, 64)),
        ("md5_round_t", many, 4, md5),
        ("md4_md5_sha1_ripemd160_iv", shared, 3, [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]),
        ("sha1_round_k", many, 2, [0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6]),
        ("sha512_round_k_prefix", many, 3, _fractions(8, 3, 64)),
        ("adler32_modulus", weak, 1, [65521]),
        ("murmur3_x86_32", many, 2, [0xCC9E2D51, 0x1B873593]),
        ("murmur3_fmix32", many, 2, [0x85EBCA6B, 0xC2B2AE35]),
        ("xxhash64_primes", many, 2, [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]),
    ]


#: The first bytes of the AES S-boxes (fixed values).
BOXES = (("aes_sbox_prefix", "637c777bf26b6fc53001672bfed7ab76"), ("aes_inverse_sbox_prefix", "52096ad53036a538bf40a39e81f3d7fb"))


def constant_hints(rows: DataFrame, key: str, sections: dict[str, tuple[str, bool]], most: int = 8) -> DataFrame:
    """(key, source, signature, strength, n_constants, evidence): the hints of each row's sections (name: column, is it assembly).

    A literal also stands for its low half if it is a sign-extended word, and for both halves if one signature has both.
    evidence: the first constants that count, as 0x... in order of place, `most` at most. Sections never count together. Each row is
    looked at alone, against the fixed table of signatures; nothing is shuffled, so frequent constants meet in no task."""

    def hints_of(name: str, column: str, assembly: bool) -> Column:
        found = F.transform(numeric_literals(F.coalesce(F.col(column), F.lit("")), assembly), lambda n, i: F.struct(i.alias("i"), literal_bits(n["literal"]).alias("bits")))
        return let(found, lambda ns: F.concat(let(_known(ns), lambda c: _counted(c, name, most)), _boxes(ns, name)))

    # An outer inline: for an inner one the planner adds a filter that does the same work again.
    return rows.select(key, F.inline_outer(F.flatten(F.array(*[hints_of(name, *of) for name, of in sections.items()])))).filter("signature is not null")


_WIDE, _EXTENDED = "00000000ffffffff", "ffffffff80000000"
_NO_HINTS = "array<struct<source:string,signature:string,strength:string,n_constants:bigint,evidence:array<string>>>"


def _places() -> dict[str, list[int]]:
    """Places in the table of signatures of each constant, as 16 hex digits."""
    out: dict[str, list[int]] = {}
    for place, (*_, values) in enumerate(signatures()):
        for v in values:
            out.setdefault(f"{v:016x}", []).append(place)
    return out


def _known(ns: Column) -> Column:
    """Known constants (i, bits, of: places of their signatures), in order of place, that literals (i, bits) stand for."""
    places = _places()
    # A set decides for most literals that they are none; the map is for the rest.
    known, table = (lambda b: b.isin(list(places))), F.expr("map(" + ", ".join(f"'{b}', array({', '.join(map(str, of))})" for b, of in places.items()) + ")")
    of = lambda b: F.try_element_at(table, b)

    def stands(n: Column) -> Column:
        bits = n["bits"]
        low, high = (F.concat(F.lit("00000000"), F.substring(bits, at, 8)) for at in (9, 1))
        # A packed word counts only if one signature has both of its halves.
        packed = F.when(known(low) & known(high), F.arrays_overlap(of(low), of(high))).otherwise(False)
        wide = F.when(bits >= _EXTENDED, F.array(bits, low)).when(packed, F.array(bits, low, high)).otherwise(F.array(bits))
        found = F.when(bits > _WIDE, wide).otherwise(F.array(bits))
        return F.transform(F.filter(found, known), lambda b: F.struct(n["i"].alias("i"), b.alias("bits"), of(b).alias("of")))

    return F.sort_array(F.flatten(F.transform(ns, stands)))


def _counted(known: Column, source: str, most: int) -> Column:
    """Hints of the signatures that have enough distinct ones of the known constants."""
    table = F.expr("array(" + ", ".join(f"named_struct('signature', '{name}', 'strength', '{strength}', 'least', {least})" for name, strength, least, _ in signatures()) + ")")

    def one(place: Column) -> Column:
        own = F.array_distinct(F.transform(F.filter(known, lambda k: F.array_contains(k["of"], place)), lambda k: k["bits"]))
        shown = lambda o: F.transform(F.slice(o, 1, most), lambda v: F.concat(F.lit("0x"), F.regexp_replace(v, "^0+", "")))
        hint = lambda o, t: F.struct(F.lit(source).alias("source"), t["signature"].alias("signature"), t["strength"].alias("strength"), F.size(o).cast("long").alias("n_constants"), shown(o).alias("evidence"))
        return let(own, lambda o: let(F.get(table, place), lambda t: F.when(F.size(o) >= t["least"], hint(o, t))))

    places = F.array_distinct(F.flatten(F.transform(known, lambda k: k["of"])))
    return F.when(F.size(known) > 0, F.array_compact(F.transform(places, one))).otherwise(F.array().cast(_NO_HINTS))


def _boxes(ns: Column, source: str) -> Column:
    """Hints of eight S-box bytes in order: as eight literals, or as one of 64 bits in either order of bytes; the first of each box."""
    small = lambda n: F.startswith(n["bits"], F.lit("00000000000000"))
    codes = "ghijklmnopqrstuvwx"
    windows = {name: [prefix[i : i + 16] for i in range(0, len(prefix) - 14, 2)] for name, prefix in BOXES}
    # A window as a word and its turned word, by turns.
    words = {name: [v for w in ws for v in (w, bytes.fromhex(w)[::-1].hex())] for name, ws in windows.items()}
    all_words = [v for ws in words.values() for v in ws]

    def one(name: str) -> Column:
        # Two characters for each literal: its byte, or z and the number of its window, or signs that no window has.
        code = lambda n: F.when(small(n), F.substring(n["bits"], 15, 2)).when(n["bits"].isin(words[name]), F.concat(F.lit("z"), F.substring(F.lit(codes), F.array_position(F.array(*map(F.lit, words[name])), n["bits"]).cast("int"), F.lit(1)))).otherwise("??")
        marks = [f"z{c}" for c in codes[: len(words[name])]]
        found = F.regexp_extract(F.array_join(F.transform(ns, code), ""), f"^(?:..)*?({'|'.join([*windows[name], *marks])})", 1)
        window = lambda f: F.when(f.startswith("z"), F.get(F.array(*[F.lit(w) for w in windows[name] for _ in "ab"]), F.position(F.substring(f, 2, 1), F.lit(codes)) - 1)).otherwise(f)
        hint = lambda f: F.struct(F.lit(source).alias("source"), F.lit(name).alias("signature"), F.lit("ordered_8_bytes").alias("strength"), F.lit(8).cast("long").alias("n_constants"), F.array(window(f)).alias("evidence"))
        return let(found, lambda f: F.when(f != "", hint(f)))

    may = (F.size(F.filter(ns, small)) >= 8) | F.exists(ns, lambda n: F.coalesce(n["bits"].isin(all_words), F.lit(False)))
    return F.when(may, F.array_compact(F.array(*[one(name) for name, _ in BOXES]))).otherwise(F.array().cast(_NO_HINTS))


HEAD = "/* --- Constant signature hints (not verified algorithm names) --- */"


def hint_block(hints: DataFrame, key: str) -> DataFrame:
    """(key, block): a head and a line for each hint, by source and signature."""
    line = F.concat("signature", F.lit(" | source="), "source", F.lit(" | evidence="), F.array_join("evidence", ","), F.lit(" | strength="), "strength")
    of = F.transform(F.sort_array(F.collect_list(F.struct("source", "signature", line.alias("line")))), lambda h: h["line"])
    return hints.groupBy(key).agg(F.concat(F.lit(HEAD + "\n"), F.array_join(of, "\n")).alias("block"))
