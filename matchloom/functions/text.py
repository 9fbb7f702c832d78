"""Normal forms of names and addresses as column expressions; Python only for decomposition."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab

INDIC = "[ऀ-෿]"


@dataclass(frozen=True)
class NormProfile:
    """What a country's normaliser adds: the extended one collapses dotted acronyms and maps roles and regions."""

    extended: bool = False


BASE, EXTENDED = NormProfile(), NormProfile(True)


def has_indic(text: Column) -> Column:
    return F.coalesce(text.rlike(INDIC), F.lit(False))


@F.pandas_udf(StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold(text: Column) -> Column:
    """Special letters by table, decomposed, without combining marks, lower case. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    one = {k: v for k, v in vocab.SPECIAL.items() if len(v) == 1}
    gone = "".join(k for k, v in vocab.SPECIAL.items() if not v)
    out = F.translate(text, "".join(one) + gone, "".join(one.values()))
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in vocab.SPECIAL.items() if len(v) > 1), out)
    return F.lower(_decompose(out))


def in_list(words) -> "callable":
    known = sorted(words)
    return lambda x: x.isin(known)


def mapped(words: dict[str, str]):
    table = F.create_map(*[F.lit(x) for kv in sorted(words.items()) for x in kv])
    known = in_list(words)
    return lambda x: F.when(known(x), table[x]).otherwise(x)


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))


def deleet(token: Column) -> Column:
    """Digits as letters in tokens that mix both."""
    return F.when(token.rlike("[0-9]") & token.rlike("[a-z]"), F.translate(token, vocab.LEET_FROM, vocab.LEET_TO)).otherwise(token)


def name_text(name: Column, profile: NormProfile = BASE) -> Column:
    """Folded, with signs as words and id notes gone."""
    f = fold(name)
    if profile.extended:
        f = F.regexp_replace(f, r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\.[a-z])\.(?=[a-z](?![a-z]))|(?<=\.[a-z])\.(?![a-z])", "")
        for words, role in vocab.ROLE_FORMS:
            f = F.regexp_replace(f, rf"\b(?:{words})\b", role)
    f = F.replace(F.replace(f, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    return F.regexp_replace(f, r"\(?\bid\s*:\s*\d+\)?", " ")


ALIAS = r"\b(?:" + "|".join(vocab.ALIASES) + r")\b"


def alias_parts(folded: Column) -> tuple[Column, Column]:
    """What stands before and after the first alias word; null where there is none."""
    has = folded.rlike(ALIAS)
    pre = F.regexp_extract(folded, "^((?s).*?)" + ALIAS, 1)
    post = F.regexp_extract(folded, "^(?s).*?" + ALIAS + "((?s).*)$", 1)
    return F.when(has, F.trim(pre)), F.when(has, F.trim(post))


def name_tokens(folded: Column) -> Column:
    return F.transform(tokens(folded), deleet)


def core_tokens(toks: Column, profile: NormProfile = BASE) -> Column:
    stop = in_list(vocab.LEGAL | vocab.HONOR | (vocab.EXTENDED_NOISE if profile.extended else vocab.NOISE))
    return F.filter(toks, lambda t: ~stop(t))


BLANKS = " \t\n\x0b\x0c\r"


def address_components(address: Column, profile: NormProfile = BASE) -> Column:
    """Comma-separated parts of the folded address without PO boxes and words for nothing; ordinals and zero-led numbers as plain
    numbers, over the whole line at once."""
    f = F.regexp_replace(fold(address), r"\b(?:p\.?\s*o\.?\s*box|pmb)\s*#?\s*\d+", " ")
    f = F.regexp_replace(f, r"(?<![a-z0-9])(\d+)(?:st|nd|rd|th)(?![a-z0-9])", "$1")
    f = F.regexp_replace(f, r"(?<![a-z0-9])0+(?=[0-9]+(?![a-z0-9]))", "")
    parts = F.transform(F.split(f, ","), lambda c: F.btrim(c, F.lit(BLANKS)))
    return F.filter(parts, lambda c: ~c.isin("", "null", "n/a", "na"))


def address_tokens(components: Column, profile: NormProfile = BASE) -> Column:
    """A state's name as a whole part is its code; else each token in its canonical form."""
    states = vocab.STATES | (vocab.FR_REGIONS if profile.extended else {})
    forms = vocab.ADDRESS_FORMS | (vocab.EXTENDED_ADDRESS if profile.extended else {})
    part = lambda c: F.when(in_list(states)(c), F.array(mapped(states)(c))).otherwise(F.transform(tokens(c), mapped(forms)))
    return F.flatten(F.transform(components, part))


def address_core(toks: Column, profile: NormProfile = BASE) -> Column:
    drop = in_list(vocab.ADDRESS_DROP | set(vocab.STATES.values()) | (set(vocab.FR_REGIONS.values()) if profile.extended else set()))
    return F.filter(toks, lambda t: ~drop(t))


def numbers(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9]+$"))


def legal_forms(name: Column) -> Column:
    """The sorted set of legal forms in a name, joined by commas."""
    toks = F.regexp_extract_all(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("."), F.lit("")), F.lit("[a-z]+"), F.lit(0))
    known = F.transform(F.filter(toks, in_list(vocab.LEGAL_FORMS)), mapped(vocab.LEGAL_FORMS))
    return F.array_join(F.array_sort(F.array_distinct(known)), ",")


def prepared(records: DataFrame, profile: NormProfile = BASE, names: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    """Records with their token views: nf, nt, core, al_pre, al_post, comps, at, acore, ncomp, oov. Native scripts are written in
    Latin letters first, by the dictionaries names and components (see romanised) and by rule."""
    r = romanised(records, names, components)
    r = r.withColumn("nf", name_text(F.col("name_latin"), profile))
    pre, post = alias_parts(F.col("nf"))
    r = r.withColumns({"nt": name_tokens(F.col("nf")), "al_pre": pre, "al_post": post, "comps": address_components(F.col("address_latin"), profile)})
    r = r.withColumns({"core": core_tokens(F.col("nt"), profile), "at": address_tokens(F.col("comps"), profile), "ncomp": F.size("comps")})
    return r.withColumn("acore", address_core(F.col("at"), profile)).drop("name_latin", "address_latin")


def serialised(name: Column, address: Column, latin: Column | None = None) -> Column:
    """A record as one line of text for a pair scorer; a missing address is unknown, not different."""
    addr = F.when(F.trim(F.coalesce(address, F.lit(""))) == "", "[none]").otherwise(address)
    shown = name if latin is None else F.when(latin.isNotNull() & (latin != name), F.concat(name, F.lit(" ("), latin, F.lit(")"))).otherwise(name)
    return F.concat(F.lit("name: "), shown, F.lit(" ; address: "), addr)


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "" if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())


def street_words(address: Column) -> Column:
    """Words of the first comma part with a digit, without stop words, numbers and words below three letters."""
    parts = F.split(F.regexp_replace(ascii_fold(address), "[^a-z0-9 ,]", " "), ",")
    seg = F.coalesce(F.get(F.filter(parts, lambda p: p.rlike("[0-9]")), F.lit(0)), F.lit(""))
    stop = in_list(vocab.STREET_STOP)
    return F.filter(F.split(F.trim(seg), " +"), lambda w: (F.length(w) >= 3) & ~stop(w) & ~w.rlike(r"^\d+\w*$"))


# --- Brahmic scripts ---------------------------------------------------------------------------------------------------

SIGNS = "".join(vocab.VOWEL_SIGNS) + "\u094d"
#: Blocks from Bengali to Sinhala have the layout of Devanagari, 0x80 apart.
BLOCKS = "".join(map(chr, range(0x980, 0xE00)))
DEVANAGARI = "".join(chr(0x900 + i) for i in range(0x80)) * (len(BLOCKS) // 0x80)
#: What each letter is written as. A consonant's vowel is written by the rule, so the table's goes.
WRITTEN = {c: latin.removesuffix("a") for c, latin in vocab.CONSONANTS.items() if len(c) == 1} | vocab.VOWELS | vocab.VOWEL_SIGNS | vocab.OTHER_SIGNS | {chr(0x966 + d): str(d) for d in range(10)}
CONSONANT_CLASS = "[" + "".join(c for c in vocab.CONSONANTS if len(c) == 1) + "]"


def transliterated(word: Column) -> Column:
    """A word of a Brahmic script in Latin letters: a consonant is read with an a unless a vowel sign or virama follows it or
    the word ends. Other signs and letters that have no Latin are left out."""
    word = F.translate(word, BLOCKS, DEVANAGARI)
    voiced = F.regexp_replace(word, f"({CONSONANT_CLASS})(?=[^{SIGNS}])", "$1a")
    known = F.create_map(*[F.lit(x) for kv in WRITTEN.items() for x in kv])
    return F.array_join(F.transform(F.split(voiced, ""), lambda c: F.coalesce(known[c], F.when(c.rlike("^[\\x00-\\x7f]$"), c), F.lit(""))), "")


def _words(name: Column) -> Column:
    return F.split(F.regexp_replace(name, "^\\s+|\\s+$", ""), "\\s+")


def romanised(records: DataFrame, names: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    """records with name_latin, address_latin and oov, the number of native words that no dictionary has.

    names (word, latin): native words of names; those it lacks are written by rule. components (word, latin): native parts of
    addresses between commas; those it lacks stay. Dictionaries of any size are joined with the words of native records
    only; other records pass by, unshuffled. Records have an id of their own each; null names are null, with oov 0.
    """
    native = has_indic(F.col("name"))
    by_rule = F.array_join(F.transform(_words(F.col("name")), lambda w: F.when(w.rlike(INDIC), transliterated(w)).otherwise(w)), " ")
    unknown = F.size(F.filter(_words(F.col("name")), lambda w: w.rlike(INDIC)))
    r = records.withColumns({"name_latin": F.when(native, by_rule).otherwise(F.col("name")), "address_latin": F.col("address"), "oov": F.when(native, unknown).otherwise(0)})
    if names is None and components is None:
        return r
    odd = native | has_indic(F.col("address"))
    rest, found = r.where(~odd), r.where(odd)
    if names is not None:
        words = found.where(native).select("id", F.posexplode(_words(F.col("name"))).alias("pos", "word")).join(names.select("word", "latin"), "word", "left")
        own = F.col("word").rlike(INDIC)
        latin = F.when(own, F.coalesce("latin", transliterated(F.col("word")))).otherwise(F.col("word"))
        lines = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", latin.alias("x")))).alias("_w"), F.sum(F.when(own & F.col("latin").isNull(), 1).otherwise(0)).cast("int").alias("_o"))
        found = found.join(lines, "id", "left").withColumns({"name_latin": F.when(native, F.array_join(F.col("_w.x"), " ")).otherwise(F.col("name")), "oov": F.coalesce("_o", F.lit(0))}).drop("_w", "_o")
    if components is not None:
        native_address = has_indic(F.col("address"))
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^\\s+|\\s+$", ""), '^"+|"+$', "")
        parts = found.where(native_address).select("id", F.posexplode(F.transform(F.split("address", ","), bare)).alias("pos", "word")).join(components.select("word", "latin"), "word", "left")
        lines = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("latin", "word").alias("x")))).alias("_p"))
        found = found.join(lines, "id", "left").withColumn("address_latin", F.when(native_address, F.array_join(F.col("_p.x"), ", ")).otherwise(F.col("address"))).drop("_p")
    return rest.unionByName(found.select(rest.columns))
