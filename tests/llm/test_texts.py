"""Leak detection, context packing and personal information, with their edge cases."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordmill.llm import leakage, packing, privacy

VOCABULARY = os.path.join(os.environ.get("FJORDMILL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, id long, fp long, item long"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], DOC)


def _items(spark, texts):
    return spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "item_id long, text string, doc_id long")


def _words(t):
    return re.findall(r"[^\W_]+", (t or "").casefold())


def _brute(docs, items, run):
    grams = {}
    for i, t in enumerate(items):
        w = _words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in enumerate(docs) for w in [_words(t)] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}


def test_leaks_match_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "ßx", "naïve", "x²", "一二", "😀"]
    items = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(30)] + [None, "", "only a few words here"]
    docs = []
    for _ in range(120):
        t = rnd.choices(words, k=rnd.randint(0, 60))
        w = (rnd.choice(items) or "").split()
        if w and rnd.random() < 0.7:
            a = rnd.randint(0, len(w) - 1)
            part = w[a : a + rnd.randint(8, 16)]
            at = rnd.randint(0, len(t))
            t = t[:at] + part + t[at:]
        s = rnd.choice([" ", "\n> ", "--", " \x00 "]).join(t)
        docs.append(s.upper() if rnd.random() < 0.2 else s)
    docs += [None, "", items[0], items[0], "y " * 30_000 + items[1] + " z" * 30_000]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(_docs(spark, docs), _items(spark, items), run=12).collect()}
    assert got == _brute(docs, items, 12) and got
    assert leakage.leaks(_docs(spark, docs).limit(0), _items(spark, items)).count() == 0
    assert leakage.leaks(_docs(spark, docs), _items(spark, [None])).count() == 0


def _brute_passages(docs, items, run):
    out = set()
    for d, t in enumerate(docs):
        for i, u in enumerate(items):
            a, b = _words(t), _words(u)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= run:
                            out.add((d, i, x, y, n))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_passages_of_any_length(spark, monkeypatch, hot):
    monkeypatch.setattr(leakage, "HOT", hot)  # 3: frequent fingerprints are divided
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    items = [" ".join(rnd.choices(words, k=n)) for n in (12, 40, 300)] + ["a b " * 30, "short"]
    docs = [" ".join([*rnd.choices(words, k=5), *items[k].split()[a : a + n], *rnd.choices(words, k=4), *items[1].split()[3:20]]) for k, a, n in ((2, 10, 250), (2, 0, 300), (1, 5, 11), (1, 5, 12), (0, 0, 12))] + ["b " + "a b " * 15, ""]
    docs += [items[2]] * 5
    got = [tuple(r) for r in leakage.passages(_docs(spark, docs), _items(spark, items), run=12).select("doc_id", "item_id", "doc_word", "item_word", "n_words").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_passages(docs, items, 12)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(_docs(spark, docs), _items(spark, items)).collect()} == {g[:2] for g in got}


def test_winnowing_keeps_one_per_window():
    h = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    row = np.repeat([0, 1], [150, 150])
    pos, _ = leakage.fingerprints(h, row, 4, 5)
    for a in (0, 150):
        own = pos[(pos >= a) & (pos < a + 150)]
        assert np.diff(own).max() <= 5 and own[0] - a < 5


TEXTS = ["", "a", "it's 's'", "don't  you'll\n\n 'd'", "x  y  ", "\n \n a", "  ", "'s", "we'll've'S", "漢字 😀😀 x", "I'm'm ''s", "> quoted\nplain ö", "tab\there\r\n\r\n  end "]


def test_token_counts_equal_the_encoder():
    c = packing.Counter(VOCABULARY)
    rnd = random.Random(7)
    texts = TEXTS + ["".join(rnd.choices(list("ab's 'd1\n\t.,é漢 "), k=rnd.randint(1, 80))) for _ in range(400)]
    for part in (texts, texts[::-1]):
        tokens = c.measure(part)[0]
        assert tokens.tolist() == [len(c.encoding.encode_ordinary(t)) for t in part]


def test_pack_respects_all_limits():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 101, 3000)
    loss = np.minimum((tokens * rng.random(3000)).astype(int), 60)
    where = packing.pack(tokens, loss, (100, 6, 60))
    assert (where >= 0).all()
    for w, cap in ((tokens, 100), (np.ones(3000), 6), (loss, 60)):
        assert np.bincount(where, weights=w).max() <= cap
    where = packing.pack(tokens, np.zeros(3000, int), (100, 100, 100))
    assert tokens.sum() / 100 / (where.max() + 1) > 0.98
    with pytest.raises(ValueError):
        packing.pack(tokens, loss + 61, (100, 6, 60))


def test_cuts_end_at_the_first_limit():
    rng = np.random.default_rng(9)
    for cap, most in ((50, 20), (50, 50), (7, 1), (5, 0)):
        told, lossy = rng.integers(1, 6, 200), rng.random(200) < 0.5
        each = np.repeat(lossy, told)
        starts = packing.cuts(told, lossy, cap, most).tolist()
        for a, b in zip(starts, [*starts[1:], len(each)]):
            assert 0 < b - a <= cap and each[a:b].sum() <= max(1, most)
            assert b == len(each) or b - a == cap or each[a : b + 1].sum() > max(1, most)


@pytest.mark.parametrize("loss_capacity", [None, 20])
def test_contexts_whole_and_full(spark, loss_capacity):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["alpha", "beta", "> gamma\n", "delta"], k=rnd.randint(0, 60))) for _ in range(300)] + [None, "", "word " * 500, "word " * 500, "> " + "word " * 300 + "\n" + "漢字" * 90]
    packed = packing.contexts(_docs(spark, texts), vocabulary=VOCABULARY, capacity=64, segments=8, loss_capacity=loss_capacity)
    rows = packed.collect()
    c = packing.Counter(VOCABULARY)
    codes = {i: c.encoding.encode_ordinary(t) for i, t in enumerate(texts) if t}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(codes[r.doc_id][r.start : r.start + r.tokens])
    assert got == {i: n for i, n in codes.items() if n}
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    per = {}
    for r in rows:
        a = per.setdefault(r.context, [0, 0, 0])
        a[0] += r.tokens
        a[1] += 1
        a[2] += r.loss
    assert all(t <= 64 and n <= 8 and k <= (loss_capacity or 64) for t, n, k in per.values())
    if not loss_capacity:
        assert all(r.piece == 0 for r in rows if len(codes[r.doc_id]) <= 64)
    told = packing.usage(packed, 64, 8, loss_capacity).first()
    assert (told.used_loss if loss_capacity else told.used) > 0.9 and told.n_tokens == sum(map(len, codes.values()))
    bad = packing.faults(packed, 64, 8, loss_capacity).first()
    assert (bad.n_texts, bad.n_badly_cut, bad.n_over) == (len([1 for x in codes.values() if x]), 0, 0)
    assert packing.contexts(_docs(spark, texts).limit(0), vocabulary=VOCABULARY).count() == 0


GIVEN = ["Stelma", "Trausine", "Griadun", "Kaury", "Nisor", "Vaulmik", "Brålmine", "Zaleth"]
FAMILY = ["Tarvabekk", "Flialavik", "Gorasson", "Polkaheim", "Riasarud", "Skénaetti", "Pervimark", "Zanoovan", "Ridge"]
NAMES = [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY]


def _model():
    rnd = random.Random(1)
    texts = []
    for _ in range(400):
        g, f = rnd.choice(GIVEN), rnd.choice(FAMILY[:-1])
        texts.append(
            f"Hallo {rnd.choice(GIVEN)},\nThe Hosonella gruroula enzyme bound NAG6. We thank {g} {f} for reading the draft. Run {rnd.randint(1, 900)} failed near the ridge. "
            f"Mail {g.lower()}.{rnd.randint(1, 9)}@mail.lab.example or call 555.555.01{rnd.randint(10, 99)}. Job 8a1 used 512 4400 {rnd.randint(10, 99)} cores. The badge form lists {rnd.randint(10**10, 10**11 - 1)} for {f}, {g}. Parcels go to {rnd.randint(1, 99)} Vralkal Lane, Luxdal 71260."
        )
    return privacy.train(texts, NAMES)


@pytest.fixture(scope="module")
def model():
    return _model()


@pytest.mark.parametrize(
    "text,found",
    [
        ("From: Dr. Stelma Q. Hosabekk <stelma(at)chem.lab.example>", [("name", "Stelma Q. Hosabekk"), ("email", "stelma(at)chem.lab.example")]),
        ("Write to a_b at mail dot lab dot test or A.B@LAB.INVALID.", [("email", "a_b at mail dot lab dot test"), ("email", "A.B@LAB.INVALID")]),
        ("Call KAURY GORASSON on +49 (0)30 23125-192 now.", [("name", "KAURY GORASSON"), ("phone", "+49 (0)30 23125-192")]),
        ("Ausweisnummer von Zaleth Polkaheim-Riasarud: 27659410-U.", [("name", "Zaleth Polkaheim-Riasarud"), ("identity", "27659410-U")]),
        ("Send it to Zondiskstraße 206, 19062 Jurvmouth. Done.", [("address", "Zondiskstraße 206, 19062 Jurvmouth")]),
        ("at Flat 6, 177 Trostarn Lane\nSkalstad 83874\n01632 960598", [("address", "Flat 6, 177 Trostarn Lane\nSkalstad 83874"), ("phone", "01632 960598")]),
        ("Hei Vaulmik,\nTag lpmo@411 is stale, pose-tools@1.58.3 too; ratio 12-418-88, accession 00-1234-144.", [("name", "Vaulmik")]),
        ("Compared with Hosonella gruroula, Grid Street is the nickname of queue 84 at the Ridge.", []),
        ("Tarvabekk, Nisor repeated it.", [("name", "Tarvabekk, Nisor")]),
        ("", []),
    ],
)
def test_spans(model, text, found):
    assert [(k, text[a:b]) for a, b, k in model.spans(text)] == found


@pytest.mark.parametrize("prefix", ["[copy] ", "+", "> ", ">> > ", "* ", "[2024-05-01 10:22] INFO: ", "\t"])
def test_greeting_behind_a_prefix(model, prefix):
    text = f"{prefix}Hallo Kaury,\nthe run is done."
    assert [(k, text[a:b]) for a, b, k in model.spans(text)] == [("name", "Kaury")]


def test_no_greeting_without_a_name(model):
    for text in ("[copy] Hallo The,\ndone.", "pre-Hallo Kaury,\ndone.", "> Hallo all,\ndone.", "XHallo Kaury,\ndone."):
        assert model.spans(text) == []


@pytest.mark.parametrize("local", ["m" + "a.b" * 1700, "a_b"])
@pytest.mark.parametrize("sign", ["@", "(at)", " (At) ", "[AT]", "{ aT }"])
@pytest.mark.parametrize("domain", ["lab.example", "x" * 5000 + ".y-z.org", "lab dot example", "lab Dot example"])
def test_emails_of_any_length_and_case(model, local, sign, domain):
    text = f"Write to {local}{sign}{domain} today, not to @ nobody or at home."
    assert [(k, text[a:b]) for a, b, k in model.spans(text)] == [("email", local + sign + domain)]


@pytest.mark.parametrize("address", [f"{'Z' + 'o' * 5000}straße 206, 19062 Jurvmouth", f"12 Tro{'st' * 3000} Lane, {'S' + 'k' * 4000}stad 83874"])
def test_addresses_of_any_length(model, address):
    text = f"Send it to {address}. Done."
    assert [(k, text[a:b]) for a, b, k in model.spans(text)] == [("address", address)]


def test_long_names_and_texts_without_blanks(model):
    text = f"We thank Nisor{'a' * 200}-Tarva Gorasson-{'B' + 'e' * 300}kk for it."
    assert any(k == "name" and "Gorasson" in text[a:b] for a, b, k in model.spans(text)) or model.spans(text) == []
    for filler in ("x" * 300_000, "@" * 20_000, " dot " * 20_000, "a@b" * 20_000, "Street " * 20_000):
        model.spans(filler)  # ends, in time linear in the text


def test_gazetteer_table(spark, model):
    names = spark.createDataFrame([(f"N{i}", "given") for i in range(3000)] + [(None, "given"), ("X", None)], "name_text string, name_kind string")
    table = privacy.gazetteer(names)
    words = privacy.Words(table, None)
    assert all(words.listed(f"n{i}", "given") for i in range(3000))
    assert sum(words.listed(f"other{i}", "given") for i in range(3000)) < 60 and len(table) * 64 <= 1 << 17
    assert np.array_equal(privacy.gazetteer(names.limit(0)), np.zeros(1 << 10, np.uint64))


def test_found_and_redacted(spark, model):
    texts = ["We thank Nisor Gorasson for it.", None, "", "plain", "x " * 50_000 + "call 555.555.0145", "We thank Nisor Gorasson for it."]
    df = _docs(spark, texts)
    got = {(r.doc_id, r.pii_type, r.pii_text) for r in privacy.found(df, model).collect()}
    assert got == {(0, "name", "Nisor Gorasson"), (5, "name", "Nisor Gorasson"), (4, "phone", "555.555.0145")}
    out = {r.doc_id: (r.text, r.n_replaced) for r in privacy.redacted(df, model).collect()}
    assert out[0] == ("We thank [NAME] for it.", 1) and out[1] == (None, 0) and out[2] == ("", 0) and out[3] == ("plain", 0) and out[4][0].endswith("call [PHONE]")
    assert privacy.found(df.limit(0), model).count() == 0


def test_fit_is_repeatable_and_bounded(spark):
    names = spark.createDataFrame([(n, k) for n, k in NAMES] + [(None, "given")], "name_text string, name_kind string")
    df = _docs(spark, [f"We thank {g} {f} for reading." for g in GIVEN for f in FAMILY])
    a, b = (privacy.fit(df, names, sample=40) for _ in range(2))
    assert np.allclose(a.weights, b.weights)
    empty = privacy.fit(df.limit(0), names.limit(0))
    assert privacy.found(df, empty).where("pii_type = 'name'").count() == 0


def test_fit_takes_all_texts_and_names(spark):
    """More texts and names than the 3,000 and 100,000 that were once the most: the same model as on one machine."""
    rnd = random.Random(7)
    made = sorted({"".join(rnd.choices("abdeiklmnorstuvy", k=rnd.randint(4, 8))).capitalize() for _ in range(110_000)})
    names = NAMES + [(n, "family") for n in made]
    texts = [f"Notes on Zq{''.join(rnd.choices('abcdefgh', k=5))} are kept. We thank {rnd.choice(GIVEN)} {rnd.choice(FAMILY)} for item {i}. Call 555.555.01{i % 90 + 10} now." for i in range(3100)]
    texts += [f"Some gralbic words. Mail {i}.x@lab.example, attn {rnd.choice(made)}, Nisor." for i in range(20)] + [None]
    listed = spark.createDataFrame(names, "name_text string, name_kind string")
    got, whole = privacy.fit(_docs(spark, texts), listed), privacy.train(texts[:-1], names, privacy.gazetteer(listed))
    assert len(made) > 100_000 and "gralbic" in got.words.common and got.words.common == whole.words.common
    assert all(np.allclose(got.words.weights[k], whole.words.weights[k]) for k in ("given", "family"))
    assert all(np.allclose(got.tables[k], whole.tables[k]) for k in privacy.TYPES)
    assert np.allclose(got.weights, whole.weights, atol=1e-4)


def test_what_is_known_is_a_share():
    """Ten times the same spans are judged like one of each, whatever their number."""
    rng = np.random.default_rng(3)
    patterns = {privacy._pattern(4, v): int(n) for v, n in zip(rng.integers(-1, 2, (60, privacy.VOTES)).tolist(), rng.integers(1, 900, 60))}
    one, ten = privacy._judge(patterns, 1.0), privacy._judge({k: 10 * n for k, n in patterns.items()}, 10.0)
    assert np.allclose(one[0], ten[0]) and privacy._weight(30_000) == 10 and privacy._weight(20) == 1
    # counts stand for as many equal rows
    votes = np.array([v for k, n in patterns.items() for v in [privacy._votes_of(np.array([k]))[1][0]] * n])
    p, table = privacy.reliabilities(votes)
    by_count = privacy.reliabilities(privacy._votes_of(np.array(list(patterns)))[1], counts=np.array(list(patterns.values()), float))
    assert np.allclose(table, by_count[1])


def test_descent_finds_the_lowest_point():
    rng = np.random.default_rng(5)
    low, steep = rng.standard_normal(privacy.WEIGHTS), 10 ** rng.uniform(-1, 1, privacy.WEIGHTS)
    w = privacy._descend(lambda w: np.concatenate([[(steep * (w - low) ** 2).sum() / 2 + np.logaddexp(0, w - low).sum() - (w - low).sum() / 2], steep * (w - low) + 1 / (1 + np.exp(low - w)) - 0.5]))
    assert np.allclose(w, low, atol=1e-4)


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.6
    votes = np.zeros((3000, privacy.VOTES), int)
    for k, p in enumerate((0.95, 0.9, 0.85, 0.55)):
        votes[:, k] = np.where(rng.random(3000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1))
    p, table = privacy.reliabilities(votes)
    assert ((p > 0.5) == truth).mean() > 0.97
    assert table[1, 0, 2] > table[1, 3, 2] + 0.2
