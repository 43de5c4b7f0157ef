"""Strings, tokenizer, stemmer, lemmas and codec against examples with known results."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import lzw, strings
from millrace.functions.lemma import Lexicon, lemmatize_words
from millrace.functions.stem import stem_words
from millrace.functions.tokens import TokenOptions, token_rows, token_texts, words

# fixed values: words and their stems
STEMS = """running run jumps jump easily easili houses hous ponies poni caresses caress walked walk computed comput a a an an the the
relational relat conditional condit rational ration triplicate triplic formative form formalize formal RUNNING run hopping hop hoping hope
complexity complex electrical electric hopeful hope goodness good revival reviv allowance allowanc inference inferenc airliner airliner
gyroscopic gyroscop probate probat rate rate cease ceas happy happi sky sky agree agre agreed agreed disabled disabl sized size
internationalization internation responsibilities respons characterization character consignment consign tree tre flying fly dying dy
syzygy syzygi national nation happiness happi nots not ands and ors or aed a Hi Hi""".split()

# fixed values: words and their lemmas
LEMMAS = """lay lie leaves leave more much most much spun spin spinning spin arose arise cacti cactus stimuli stimulus series series swollen swell am be is be are be was be were be children child men man women woman feet foot teeth tooth better good best good worse bad worst bad
running run cats cat went go took take gave give saw see taken take given give seen see written write spoken speak broken break
data datum criteria criterion phenomena phenomenon bacteria bacterium curricula curriculum analyses analysis hypotheses hypothesis theses thesis
parentheses parenthesis mice mouse geese goose oxen ox lice louse understood understand overthrown overthrow withdrawn withdraw
undertaken undertake sang sing swam swim rang ring drank drink kept keep slept sleep meant mean dealt deal a a I i""".split()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_stems(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = stem_words(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()
    assert {r["word"]: r["stem"] for r in rows} == pairs


class PlainStemmer:
    """The stemmer's rules by loops over characters."""

    TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log", "fulli": "ful", "lessli": "less"}
    THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    FOUR = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split()

    @staticmethod
    def consonants(w):
        out = []
        for i, ch in enumerate(w):
            out.append(not out[-1] if ch == "y" and i else ch not in "aeiou")
        return out

    def m(self, w):
        k = self.consonants(w)
        return sum(a and not b for a, b in zip(k, k[1:], strict=False))

    def vowel(self, w):
        return not all(self.consonants(w))

    def double(self, w):
        return len(w) > 1 and w[-1] == w[-2] and self.consonants(w)[-1]

    def cvc(self, w):
        return self.consonants(w)[-3:] == [True, False, True] and w[-1] not in "wxy"

    def replaced(self, w, rules):
        for end, new in rules.items():
            if w.endswith(end):
                return w[: -len(end)] + new if self.m(w[: -len(end)]) > 0 else w
        return w

    def __call__(self, word):
        if len(word.encode()) < 3:
            return word
        w = "".join(c.lower() if c.isascii() else c for c in word)
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: -len(end)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if self.m(w[:-3]) > 0 else w
        else:
            end = next((e for e in ("ed", "ing") if w.endswith(e) and self.vowel(w[: -len(e)])), None)
            if end:
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif self.double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif self.m(w) == 1 and self.cvc(w):
                    w += "e"
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self.replaced(self.replaced(w, self.TWO), self.THREE)
        for end in self.FOUR:
            stem = w[: -len(end)]
            if w.endswith(end) and (end != "ion" or stem.endswith(("s", "t"))) and self.m(stem) > 1:
                w = stem
                break
        if w.endswith("e") and (self.m(w[:-1]) > 1 or self.m(w[:-1]) == 1 and not self.cvc(w[:-1])):
            w = w[:-1]
        return w[:-1] if self.m(w) > 1 and self.double(w) and w[-1] == "l" else w


def test_stems_against_loops(spark):
    """The vocabulary of a table, and words made of parts that the rules look at."""
    import random

    plain = PlainStemmer()
    assert {w: plain(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    rng = random.Random(7)
    parts = [*"aeiouybcdlmnrstwxyz", "ll", "ss", "tt", "yy", "at", "bl", "iz", "ion", "ing", "ed", "eed", "ies", *plain.TWO, *plain.THREE, *plain.FOUR]
    made = {"".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(6000)}
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made |= {w for t in texts for w in re.findall("[A-Za-z]+", t or "")}
    made = {w for w in made if "y" * 9 not in w}
    rows = stem_words(spark.createDataFrame([(w,) for w in sorted(made)], "word string")).collect()
    assert [(r["word"], r["stem"]) for r in rows if r["stem"] != plain(r["word"])] == []


def test_lemmas(spark):
    pairs = dict(zip(LEMMAS[::2], LEMMAS[1::2], strict=True))
    lexicon = Lexicon().add("customword", "first").add("CustomWord", "custom")
    rows = lemmatize_words(spark.createDataFrame([(w,) for w in [*pairs, "customword"]], "word string"), lexicon).collect()
    assert {r["word"]: r["lemma"] for r in rows} == pairs | {"customword": "custom"}


def test_token_options(spark):
    t = F.col("t")
    assert one(spark, token_texts(t, TokenOptions(skip_numbers=False)), t="test 123 abc") == ["test", "123", "abc"]
    assert one(spark, token_texts(t), t="test 123 abc") == ["test", "abc"]
    assert one(spark, token_texts(t, TokenOptions(skip_punctuation=False)), t="Hello, world!") == ["hello", ",", "world", "!"]
    assert one(spark, words(t, TokenOptions(lower=False)), t="HELLO World") == ["HELLO", "World"]
    assert one(spark, words(t, TokenOptions(min_length=3)), t="a ab abc abcd") == ["abc", "abcd"]
    assert one(spark, words(t), t=" \t\n") == []
    assert one(spark, words(t), t="self-driving car 12abc-3") == ["self-driving", "car", "abc-3"]


def test_token_offsets(spark):
    docs = spark.createDataFrame([(1, "Schpfö 12,5 self-driving!\n\tOK"), (2, ""), (3, None)], "doc_id long, text string")
    rows = token_rows(docs, TokenOptions(False, False, False, False)).orderBy("doc_id", "seq").collect()
    assert [r["token"] for r in rows] == ["Schpf", "ö", " ", "12,5", " ", "self-driving", "!", "\n\t", "OK"]
    assert [r["length"] for r in rows] == [5, 2, 1, 4, 1, 12, 1, 2, 2]
    assert [r["position"] for r in rows] == [0, 5, 7, 8, 12, 13, 25, 26, 28]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (lambda t: strings.normalize(t), "Hello, World!", "helloworld"),
        (lambda t: strings.normalize(t), "Test123", "test123"),
        (lambda t: strings.trim(t), "  hello  ", "hello"),
        (lambda t: strings.trim(t), "  ", ""),
        (lambda t: strings.split(t, ","), "a,,b,c,", ["a", "b", "c"]),
        (lambda t: strings.join(strings.split(t, ","), ", "), "a,b,c", "a, b, c"),
        (lambda t: strings.to_upper(t), "öa", "öA"),
        (lambda t: strings.to_lower(t), "ÖA", "Öa"),
        (lambda t: strings.find(t, "b"), "abcb", 1),
        (lambda t: strings.find(t, "b", 2), "abcb", 3),
        (lambda t: strings.find(t, "z"), "abcb", -1),
        (lambda t: strings.rfind(t, "b"), "abcb", 3),
        (lambda t: strings.rfind(t, "z"), "abcb", -1),
        (lambda t: strings.substr(t, 9, 2), "abc", ""),
        (lambda t: strings.size_bytes(t), "ö", 2),
        (lambda t: strings.hex_decode(t), "abc", None),
        (lambda t: strings.remove_punctuation(t), "(a-b)/[c]\\'d'", "abcd"),
    ],
)
def test_strings(spark, function, text, expected):
    assert one(spark, function(F.col("t")), t=text) == expected


def test_double_text_truncates(spark):
    row = spark.createDataFrame([(1.999,)], "x double").select(strings.double_text(F.col("x"), 2).alias("x")).first()
    assert row["x"] == "1.99"


@pytest.mark.parametrize(("raw", "digits"), [(b"", "ff0f"), (b"a", "61f0ff"), (b"aaaa", "61001061f0ff"), (b"hello world", "6850066cc0066f000277f00672c00664f0ff"), (b"compress me please", "63f0066d000772500673300720d00665000270c006651006735006ff0f")])
def test_lzw_bytes(raw, digits):
    assert lzw.compress(raw).hex() == digits
    assert lzw.decompress(bytes.fromhex(digits)) == raw


def plain_lzw(data):
    """The codec by whole strings and single bits."""
    table, codes, known = {bytes([i]): i for i in range(256)}, [], b""
    for b in data:
        longer = known + bytes([b])
        if longer not in table:
            codes.append(table[known])
            if len(table) < 4095:
                table[longer] = len(table)
            longer = bytes([b])
        known = longer
    codes += ([table[known]] if known else []) + [4095]
    bits = "".join(f"{c:012b}"[::-1] for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000) | st.text(alphabet="abc ", max_size=9000).map(str.encode))
def test_lzw_against_whole_strings(data):
    assert lzw.compress(data) == plain_lzw(data)


def test_lzw_ratio_of_the_table(spark):
    from millrace.plans import registry

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["bytes"], r["packed"]) for r in registry.REGISTRY["lzw_ratio"](spark, sf).collect()}
    assert got == {i: (len(t), len(plain_lzw(t))) for i, t in texts.items()}


def test_lzw_sizes():
    assert [len(lzw.compress(x)) for x in (b"a" * 20_000, bytes(range(256)) * 2, b"the quick brown fox jumps over the lazy dog " * 5000)] == [302, 578, 6608]


def test_lzw_bad_code():
    assert lzw.decompress(lzw.pack_codes([97, 300, lzw.END])) == b""


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_roundtrip(data):
    assert lzw.decompress(lzw.compress(data)) == data


def test_lzw_text(spark):
    assert one(spark, lzw.decompress_text(lzw.compress_text(F.col("t"))), t="Grüße, Welt") == "Grüße, Welt"
    assert one(spark, lzw.decompress_text(F.col("t")), t="abc") is None
