"""Garbled texts: planted swaps are found and undone, foreign and odd characters are left alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seriesmill.llm import bigrams, codepages, garbled, letters, shared

GERMAN = "Der Kläger hat die Gebühr für die Prüfung nicht bezahlt und bestreitet die Höhe der Entschädigung. Das Gericht hält die Klage für zulässig, aber unbegründet. Müller und Größe sowie Straße genügen.".split()
FRENCH = "La société a été condamnée à réparer le préjudice causé à l’appelant, déclaré recevable après l’arrêt du tribunal où siège le président. Sûreté et intérêts sont dus à l’échéance fixée.".split()
RUSSIAN = "Суд первой инстанции установил что ответчик нарушил условия договора и обязан возместить убытки истцу в полном объёме согласно закону".split()


def sentence(rng, words, n=40):
    return " ".join(rng.choice(words) for _ in range(n))


def swap(text, true, wrong):
    return "".join(codepages.letters(wrong)[b] for b in text.encode(true))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs, planted = [], {}
    for i in range(3000):
        words = (GERMAN, FRENCH, RUSSIAN)[i % 3]
        docs.append(sentence(rng, words))
    odd = ["═════ ────", "■■■ gegen ░░░", "≈ ≤ ± ½ ‰ √2 ∞", "Ünsåk versus Çelmaz", "n° 5 § 7 ¶ 3", "état décidé", "Ηλιάκος", "☎ ♥ ✓ 🔒", "ﬁled​"]
    for i in range(90):  # only in German texts, which come before the planted ones
        docs[i * 3] += " " + odd[i % len(odd)]
    kinds = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp1251")]
    for k, (true, wrong) in enumerate(kinds):
        for j in range(2):
            i = 300 + 3 * (2 * k + j)
            planted[i] = docs[i]
            docs[i] = swap(docs[i], true, wrong)
    for k in range(6):
        i = 602 + 3 * k
        planted[i] = docs[i]
        docs[i] = swap(docs[i], "koi8-r", "cp1251") if k % 2 else swap(docs[i], "utf-8", "cp1251")
    # a single word, a doubly garbled one, lost characters
    for i, text in ((700, "Gebühr"), (703, "Höhe")):
        planted[i] = None
        docs[i] = docs[i] + " " + swap(text, "utf-8", "cp1252")
    planted[706], docs[706] = None, docs[706] + " " + swap(swap("Größe", "utf-8", "cp1252"), "utf-8", "cp1252")
    planted[709], docs[709] = None, docs[709] + " K�ln"
    return docs, planted


@pytest.fixture(scope="module")
def findings(spark, corpus):
    docs, _ = corpus
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(docs)] + [(3000, None, "s1"), (3001, "", None), (3002, " \n", "s2"), (3003, "ä" * 50000, "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df, garbled.Findings(df)


def test_found(corpus, findings):
    _, planted = corpus
    got = {r.doc_id for r in findings[1].documents().collect()}
    changed = {i for i in planted if planted[i] is None or planted[i] != corpus[0][i]}
    assert got - changed == set()
    assert len(changed - got) <= 1, changed - got


def test_restored(corpus, findings):
    docs, planted = corpus
    df, f = findings
    got = {r.doc_id: r.text for r in f.restored(df).collect()}
    whole = [i for i in planted if planted[i] is not None and i in got]
    assert sum(got[i] == planted[i] for i in whole) >= 0.95 * len(whole)
    assert got[706].endswith(" Größe") and got[700].endswith(" Gebühr")
    assert f.mapping().where("p > 0.5").count() > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert garbled.found(df).count() == 0


def test_clean_corpus(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, (GERMAN, FRENCH, RUSSIAN)[i % 3]), "one") for i in range(300)]
    assert garbled.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).count() == 0


def test_frequent_garbling(spark):
    """Found although so many texts hold it that its bigrams aren't rare in the corpus."""
    rng = random.Random(7)
    words = [f"{a}ü{b}" for a in ("f", "Pr", "geb", "Schl", "m", "begr", "verk", "Sp", "h", "gl") for b in ("r", "fung", "hren", "sse", "ndet", "lt", "ckt", "gen")]
    rows = [(i, sentence(rng, words), f"s{i % 2}") for i in range(1200)]
    hit = {i for i, _, _ in rows if i % 12 == 1}
    rows = [(i, t.replace("ü", "Ã¼") if i in hit else t, s) for i, t, s in rows]
    got = {r.doc_id for r in garbled.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {i for i, t, _ in rows if "Ã" in t}


def test_letters_that_occur_only_garbled(spark):
    """A language all of whose texts are garbled has letters that the corpus doesn't hold elsewhere."""
    rng = random.Random(9)
    polish = "zażółć gęślą jaźń państwo sąd wyrok powód pozwany świadek umowę należność odsetki stwierdził również części łącznie dług żądanie rozstrzygnięcie".split()
    rows = [(i, swap(sentence(rng, polish), "utf-8", "cp1252") if i % 4 == 0 else sentence(rng, GERMAN), "pl" if i % 4 == 0 else "de") for i in range(200)]
    got = {r.doc_id for r in garbled.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == set(range(0, 200, 4))


def test_one_letter_of_a_long_word():
    """One letter swapped alone is a candidate among more than four kinds of letters too, and is undone alone."""
    keys, n = bigrams.counts(pa.array([" ".join(RUSSIAN * 200)]))
    model = bigrams.Bigrams(keys, n)
    token = "обязан".replace("я", swap("я", "cp1251", "koi8-r"))
    read = [r for r in garbled.Reader(model)(bigrams.BLANK, token, bigrams.BLANK) if r["before"] == "обязан"]
    assert read and read[0]["gain"] > garbled.LEAST_GAIN
    assert garbled.restore(f"был {token} 5", {token: read[0]["swap"]}, model, {token: "обязан"}) == "был обязан 5"


def test_token_without_a_letter():
    keys, n = bigrams.counts(pa.array(["gegen […] und [ÖVP] " * 50]))
    read = garbled.Reader(bigrams.Bigrams(keys, n))(bigrams.BLANK, "[Ö]", bigrams.BLANK)
    assert "[…]" in {r["before"] for r in read}


#: A code page that nobody lists: letters for other characters, without any system.
UNLISTED = str.maketrans("äöüß", "Þ¤ÏŒ")
COURT = """Kläger hält erklärt Geschäft Verhältnis nämlich später wäre Gläubiger Anträge Verträge während Erklärung ergänzt Schäden
Tätigkeit ständig zunächst Länge Höhe gehört möglich können nötig Behörde öffentlich Größe lösen gewöhnlich schön hören förmlich
Zerstörung erhöht völlig Vermögen persönlich zwölf Gebühr Prüfung begründet für Rückgabe zurück führt müssen gültig Kündigung früher
natürlich Verfügung ausdrücklich künftig Rüge Grundstück übrig würde groß Straße gemäß außer Maß Schluß heißt bloß stieß weiß
schließen Verstoß Fuß Beschluß muß größer regelmäßig""".split()


def test_unlisted_page(spark):
    """A source whose German went through a swap of no listed page: told by the neighbours of its characters, and undone."""
    rng = random.Random(12)
    words = COURT + "der Vertrag ist nach Ansicht des Gerichts wirksam und die Frist war noch nicht abgelaufen".split()
    rows = []
    for i in range(900):
        lang, source = ("de", "fr")[i % 2], f"s{i % 6}"
        rows.append((i, sentence(rng, words if lang == "de" else FRENCH), source, lang))
    hit = {i for i, _, s, lang in rows if s == "s2" and lang == "de"}
    garbled_rows = [(i, t.translate(UNLISTED) if i in hit else t, s, lang) for i, t, s, lang in rows]
    df = spark.createDataFrame(garbled_rows, "doc_id bigint, text string, source string, lang string")
    f = garbled.Findings(df)
    assert [{u: v for u, (v, _) in t.items()} for t in f.letters.values()] == [{ord(c): v for v, c in (("ä", "Þ"), ("ö", "¤"), ("ü", "Ï"), ("ß", "Œ"))}]
    assert {r.doc_id for r in f.documents().collect()} == hit
    texts = {i: t for i, t, _, _ in rows}
    got = {r.doc_id: r.text for r in f.restored(df).collect()}
    assert np.mean([got[i] == texts[i] for i in hit]) >= 0.95
    assert f.mapping().where("swap = 'learned' AND p > 0.5").count() >= 3
    # the same characters in every source are letters of the language
    everywhere = [(i, t.translate(UNLISTED) if lang == "de" else t, s, lang) for i, t, s, lang in rows]
    assert garbled.Findings(spark.createDataFrame(everywhere, df.schema)).letters == {}


def test_rare_letters_are_no_swaps():
    """Characters whose neighbours fit no letter, or too few of them, stand for themselves."""
    keys = [(a, v, b) for a in range(97, 110) for v in (228, 246) for b in range(97, 110) if (a + v + b) % 3]
    l, u, r = (np.array(x) for x in zip(*keys, strict=True))
    n = np.ones(len(l), np.int64)
    pair, of = letters._pairs(l, u, r)
    k, m = np.unique(np.concatenate((pair, u)), return_inverse=True)
    counts = np.bincount(m)
    none = np.zeros(0, np.int64)
    own = np.array([97, 98, 99]), np.array([248, 248, 229]), np.array([100, 100, 100])
    assert letters.letters_of(*own, np.ones(3, np.int64), letters.Others(k, counts, none, none, none, none)) == {}
    assert letters.letters_of(none, none, none, none, letters.Others(k, counts, none, none, none, none)) == {}


def test_large_tables_are_refused(spark):
    with pytest.raises(ValueError):
        shared.fetched(spark.range(100), "numbers", 100)
    assert shared.fetched(spark.range(100), "numbers").num_rows == 100


def test_wide_words():
    texts = pa.array(["plain words", "é", "", "a Größe\tb\n日本x 5 ”", None, "x" * 10 + " " + "é" * 3]).slice(1)
    assert bigrams.wide_words(pa.array([t or "" for t in texts.to_pylist()])).to_pylist() == ["é ", "", "Größe 日本x ” ", "", "ééé "]
    assert bigrams.wide_words(pa.array(["", ""])).to_pylist() == ["", ""]


@pytest.mark.parametrize("text", ["Ã¼ber", "plain", "Größe", "â‚¬", "ÐŸÑ€", "é"])
def test_pages_of_utf8(text):
    """No page is left out by the quick look."""
    hit = {w for w in codepages.READ_AS if codepages.unread_utf8(text, w) != text}
    assert hit <= set(codepages.utf8_pages(text))


def test_form():
    assert codepages.form(swap("żć", "utf-8", "cp1252"), "utf-8>cp1252") > 4
    assert codepages.form(swap("Ж", "utf-8", "cp1252") + "é", "utf-8>cp1252") == 0  # é is part of none
    assert codepages.form("так", "utf-8>cp866") == 0  # a word, though U+282A in bytes


def test_token_hashes_match_wherever_they_stand():
    texts = pa.array(["xé1 Größe", "", "Größe 日é"])
    doc, left, right, first, last, cp = garbled._tokens(texts)
    assert garbled._cut(cp, first, last) == ["xé0", "Größe", "Größe", "é"] and doc.tolist() == [0, 0, 2, 2]
    h = garbled._hashes(np.zeros(4, np.int32), left, right, first, last, cp)
    assert h[1] == h[2] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("text", ["Größe", "l’été", "обязан", "€ 5 – “x”", "日本語"])
def test_swaps_are_undone(text):
    for wrong in codepages.READ_AS:
        read = swap(text, "utf-8", wrong)
        assert codepages.unread_utf8(read, wrong) == text
        assert text in codepages.earlier(read)
    twice = swap(swap(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    how = codepages.earlier(twice)[text]
    assert codepages.undo(twice, how) == text


def test_double_byte():
    read = swap("裁判官", "shift_jis", "cp1252")
    how = codepages.earlier_paired(read)["裁判官"]
    assert codepages.undo(read, how) == "裁判官"


def test_bigram_counts():
    texts = pa.array(["xé1", "é", "", "日本 é"])
    keys, n = bigrams.counts(texts.slice(0, 4))
    got = dict(zip(keys.tolist(), n.tolist(), strict=True))
    e, blank = ord("é"), bigrams.BLANK
    assert got[(ord("x") << 21) + e] == 1 and got[(e << 21) + bigrams.DIGIT] == 1 and got[e] == 3 and got[(e << 21) + blank] == 2
    assert got[bigrams.EAST] == 2 and got[-ord("日")] == 1 and got[(bigrams.EAST << 21) + bigrams.EAST] == 1
    cp, begin = bigrams.laid_out(texts.slice(1, 3))
    assert "".join(map(chr, cp)) == "é  日本 é " and begin.tolist() == [0, 2, 3, 8]
    assert len(np.unique(keys)) == len(keys)
