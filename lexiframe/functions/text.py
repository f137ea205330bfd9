"""Text as Columns: tokenisers, pronunciation, script conversion, packing. Nothing here but ``nfc`` leaves the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .signal import let

#: Latin words, Devanagari words and punctuation marks.
SCRIPT_PATTERN = "[A-Za-z']+|[ऀ-ॿ]+|[.,!?;:\\-]"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _any(keys) -> str:
    """An alternation that tries its members in the order given."""
    return "(" + "|".join(re.escape(k) for k in keys) + ")"


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lm_tokens(text: Column) -> Column:
    """Words of the language model: matched with their case, then lowered, so that a capital ends an apostrophe form."""
    return F.transform(pieces(text, "[a-zA-Zऀ-ॿ]+(?:'[a-z]+)?|[0-9]+"), F.lower)


def script_tokens(text: Column, lowercase: bool = True) -> Column:
    """Latin words, Devanagari words and punctuation marks; digits vanish."""
    return pieces(F.lower(text) if lowercase else text, SCRIPT_PATTERN)


def script_of(token: Column) -> Column:
    return F.when(token.rlike("^[A-Za-z]"), "latin").when(token.rlike("^[ऀ-ॿ]"), "devanagari").otherwise("other")


def split_words(text: Column) -> Column:
    """Unicode white space separates; no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def english_to_ipa(word: Column) -> Column:
    """A listed pronunciation, else letter rules, the first that fits at each place; letters without a rule are dropped."""
    w = F.lower(word)
    rules = _map(T.LETTER_RULES)
    spelled = F.array_join(F.transform(pieces(w, _any(T.LETTER_RULES)), lambda x: F.element_at(rules, x)), "")
    return F.coalesce(F.element_at(_map(T.ENGLISH_WORDS), w), spelled)


def fixups(ipa: Column) -> Column:
    for a, b in T.LATIN_FIXUPS:
        ipa = F.replace(ipa, F.lit(a), F.lit(b))
    return ipa


def decompose_nukta(text: Column) -> Column:
    """What normal form C does to Devanagari letters with a nukta; other compositions are outside this alphabet."""
    for letter, parts in T.NUKTA_LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(parts))
    return text


def devanagari_to_ipa(word: Column) -> Column:
    """Letter by letter, then without the last inherent vowel, and without those before a consonant that has a vowel.

    The word is cut into units (consonant, nukta, virama or vowel sign); each gives one or two phonemes, with a mark on inherent vowels. The second rule looks at
    the phonemes as they were before it removed any."""
    c, sign = "".join(T.DEVA_CONSONANTS), "".join(T.DEVA_SIGNS)
    units = pieces(decompose_nukta(word), f"[{c}]{T.NUKTA}?(?:{T.VIRAMA}|[{sign}])?|(?s).")
    cons, nukta, signs = _map(T.DEVA_CONSONANTS), _map(T.NUKTA_CONSONANTS), _map(T.DEVA_SIGNS)
    other = _map(T.DEVA_VOWELS | {T.ANUSVARA: T.NASAL, T.CANDRABINDU: T.NASAL, T.VISARGA: "h"})

    def phones(u: Column) -> Column:
        first, last = F.substring(u, 1, 1), F.right(u, F.lit(1))
        base = F.when(F.contains(u, F.lit(T.NUKTA)), F.coalesce(F.element_at(nukta, first), F.element_at(cons, first))).otherwise(F.element_at(cons, first))
        plain = lambda p, inherent=False: F.struct(p.alias("p"), F.lit(inherent).alias("inherent"))
        vowel = F.element_at(signs, last)
        consonant = F.when(last == T.VIRAMA, F.array(plain(base))).when(vowel.isNotNull(), F.array(plain(base), plain(vowel))).otherwise(F.array(plain(base), plain(F.lit("ə"), True)))
        return F.when(F.element_at(cons, first).isNotNull(), consonant).otherwise(F.array(plain(F.coalesce(F.element_at(other, u), u))))

    every = F.flatten(F.transform(units, phones))
    n = F.size(every)
    cut = F.when((n > 0) & (F.get(every, n - 1)["p"] == "ə"), F.slice(every, 1, F.greatest(F.lit(0), n - 1))).otherwise(every)
    vowel = lambda p: p.rlike(f"[{T.VOWEL_LETTERS}]")
    consonant = lambda p: ~vowel(p) & ~p.isin(T.NASAL, "ˈ", "·")

    def keep(x: Column, i: Column) -> Column:
        after, then = F.get(cut, i + 1)["p"], F.get(cut, i + 2)["p"]
        return ~(x["inherent"] & F.coalesce(consonant(after) & vowel(then), F.lit(False)))

    return F.array_join(F.transform(F.filter(cut, keep), lambda x: x["p"]), "")


def text_to_ipa(text: Column, separator: str = "·", lowercase: bool = True) -> Column:
    def sound(t: Column) -> Column:
        return F.when(t.rlike("^[A-Za-z]"), fixups(english_to_ipa(t))).when(t.rlike("^[ऀ-ॿ]"), devanagari_to_ipa(t)).otherwise(t)

    return F.array_join(F.transform(script_tokens(text, lowercase), sound), separator)


def ipa_to_devanagari(ipa: Column) -> Column:
    """Longest phonemes first, then one fold with the state "a bare consonant stands last".

    A vowel after a bare consonant is its sign, else a letter; a consonant after one first writes the inherent vowel; a separator forgets it; the end writes it."""
    keys = sorted([*T.IPA_CONSONANTS, *T.IPA_DIPHTHONGS, *T.IPA_VOWELS], key=lambda k: -len(k))
    units = pieces(ipa, r"[·\s]|[,.!?;:\-]|" + _any(keys))
    cons = _map(T.IPA_CONSONANTS)
    sounds = T.IPA_VOWELS | T.IPA_DIPHTHONGS
    letter, sign = _map({k: v[0] for k, v in sounds.items()}), _map({k: v[1] for k, v in sounds.items()})
    state = lambda out, bare: F.struct(out.alias("out"), bare.alias("bare"))

    def step(s: Column, u: Column) -> Column:
        put = lambda x, bare: state(F.concat(s["out"], x), bare)
        c = F.element_at(cons, u)
        return (
            F.when(u.rlike(r"^[·\s]$"), put(F.lit(" "), F.lit(False)))
            .when(u.rlike(r"^[,.!?;:\-]$"), put(u, s["bare"]))
            .when(c.isNotNull(), put(F.concat(F.when(s["bare"], "अ").otherwise(""), c), F.lit(True)))
            .otherwise(put(F.when(s["bare"], F.element_at(sign, u)).otherwise(F.element_at(letter, u)), F.lit(False)))
        )

    whole = F.aggregate(units, state(F.lit(""), F.lit(False)), step, lambda s: F.concat(s["out"], F.when(s["bare"], "अ").otherwise("")))
    return F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")


def pack_chunks(text: Column, limit: int = 400) -> Column:
    """Sentences packed greedily into chunks of ``limit`` characters; a longer sentence is a chunk of its own; without sentences, the text's head."""
    flat = F.trim(F.replace(text, F.lit("·"), F.lit(" ")))
    parts = F.filter(F.transform(F.split(F.replace(flat, F.lit("\n"), F.lit(" ")), r"\. ", -1), lambda p: F.trim(p)), lambda p: p != "")

    def step(s: Column, x: Column) -> Column:
        fits = (s["held"] > 0) & (s["held"] + x["n"] + 2 <= limit)  # held: characters of the chunk so far, of each sentence with its ". "
        return F.struct(F.when(fits, s["held"] + x["n"] + 2).otherwise(x["n"] + 2).alias("held"), F.when(fits, s["cuts"]).otherwise(F.concat(s["cuts"], F.array(x["i"]))).alias("cuts"))

    def packed(p: Column) -> Column:
        sizes = F.transform(p, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i")))
        cuts = F.aggregate(sizes, F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("cuts")), step, lambda s: s["cuts"])
        bounds = let(cuts, lambda c: F.zip_with(c, F.concat(F.slice(c, 2, F.greatest(F.lit(0), F.size(c) - 1)), F.array(F.size(p))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        return F.transform(F.filter(bounds, lambda x: x["a"] < x["b"]), lambda x: F.concat(F.array_join(F.slice(p, x["a"] + 1, x["b"] - x["a"]), ". "), F.lit(".")))

    return F.when(F.size(parts) > 0, let(parts, packed)).otherwise(F.array(F.substring(flat, 1, limit)))


def speakable(chunks: Column) -> Column:
    """Chunks without those of fewer than two characters, which give no speech."""
    return F.filter(chunks, lambda c: F.length(F.trim(c)) >= 2)


def preview(text: Column, n: int) -> Column:
    """The first n characters, those beyond ASCII as escapes."""
    escape = lambda c: F.when(c <= 0xFF, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(c)), 2, "0"))).when(c <= 0xFFFF, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(c)), 8, "0")))
    chars = pieces(F.substring(text, 1, n), "(?s).")
    return F.array_join(F.transform(chars, lambda x: let(F.ascii(x), lambda c: F.when(c < 0x80, x).otherwise(escape(c)))), "")


def count_script_tokens(text: Column) -> tuple[Column, Column]:
    """How many tokens ``script_tokens`` gives, and how many of them are Latin, without making them."""
    return F.regexp_count(text, F.lit(SCRIPT_PATTERN)), F.regexp_count(text, F.lit("(?<![A-Za-z'])[A-Za-z]"))


def nfc(text: Column) -> Column:
    """Normal form C, of any script. There is no built-in for it; texts go through Arrow in batches."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return normal(text)


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n tokens; none if there are fewer."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<array<string>>"))


def clean_runs(text: Column) -> Column:
    """Ten or more of one digit or punctuation mark in a row become a full stop."""
    return F.regexp_replace(text, r"([0-9\p{Punct}])\1{9,}", ".")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60)


def to_frame(seconds: Column, rate: int = 16000, hop: int = 160) -> Column:
    """The frame that a time falls in."""
    return F.floor(F.floor(seconds * rate) / hop).cast("long")
