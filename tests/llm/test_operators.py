"""Each operator on one small table with every awkward row, against brute force."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from marlstone.llm import common, decontam, langid, licenses, lmscore, packing, simhashgraph, suffixdedup, syncmers, tokencount, toxicity

from .conftest import SCHEMA, prose, row


def got(df):
    return [r.asDict() for r in df.collect()]


def test_language_id_sums_all_segmentations():
    path = langid.VOCABULARY
    v = langid.Vocabulary.at(path)
    rng = np.random.default_rng(0)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p: k for k, p in enumerate(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))}
    table = rng.dirichlet(np.ones(v.n))[:, None]
    scores = langid.word_scores(["ant", "banana", "zzz"], langid.extended(table), path)
    for word, s in zip(["ant", "banana", "zzz"], scores[:, 0]):
        text = "▁" + word
        total = np.zeros(len(text) + 1)
        total[0] = 1.0
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in pieces:
                    total[j] += total[i] * table[pieces[text[i:j]], 0]
        assert np.isclose(s, np.log(total[-1]), rtol=1e-4)


def log_score(word, table, pieces):
    """The forward algorithm in logarithms, over all segmentations."""
    text, a = "\u2581" + word, [0.0]
    for j in range(1, len(text) + 1):
        ways = [(a[i] + np.log(table[pieces[text[i:j]]])) if text[i:j] in pieces else a[i] + langid.BYTE_LOG * len(text[i:j].encode()) for i in range(max(0, j - 20), j) if text[i:j] in pieces or j - i == 1]
        a.append(np.logaddexp.reduce(ways))
    return a[-1]


def piece_numbers():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    return {p: k for k, p in enumerate(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))}


def test_language_id_does_not_underflow():
    pieces = piece_numbers()
    table = np.maximum(np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T, langid.LEAST)
    words = ["\U0001f600" * 20, "\U0001f600" * 39, "\u0e81" * 30, "abc" * 40, "\u7684\u662f\u4e0d\u4e86\u5728" * 16, "x" * 500, "a\U0001f600" * 25, "z"]
    scores = langid.word_scores(words, langid.extended(table), langid.VOCABULARY)
    assert np.allclose(scores, [[log_score(w, table[:, c], pieces) for c in (0, 1)] for w in words])
    assert len({round(x, 6) for x in scores.ravel().tolist()}) == scores.size


def test_language_id_query_by_brute_force(spark):
    """Fit by plain expectation maximisation over listed segmentations, and score, on a small table."""
    pieces = piece_numbers()
    rows = [row(i, prose(40 + i, 3), "a" if i % 2 else "b") for i in range(4)] + [row(9, "un\u7684\u662f x\U0001f600", None)]

    def ways(text):
        if not text:
            yield []
        for j in range(1, len(text) + 1):
            if text[:j] in pieces:
                for rest in ways(text[j:]):
                    yield [pieces[text[:j]], *rest]

    tables = []
    for lang in "ab":
        counts = Counter(w for _, t, x, *_ in rows if x == lang for w in t.split())
        prob = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(langid.ROUNDS):
            expected = np.full(len(pieces), 0.05)
            for w, n in counts.items():
                listed = list(ways("\u2581" + w))
                p = np.array([np.prod(prob[x]) for x in listed])
                for x, share in zip(listed, n * p / p.sum()):
                    np.add.at(expected, x, share)
            prob = expected / expected.sum()
        tables.append(np.maximum(prob, langid.LEAST))
    for x in got(langid.identify(spark.createDataFrame(rows, SCHEMA))):
        text = next(t for i, t, *_ in rows if i == x["doc_id"])
        chars = sum(len(w) + 1 for w in text.split())
        a, b = (sum(log_score(w, t, pieces) for w in text.split()) / chars for t in tables)
        assert x["predicted"] == ("a" if a >= b else "b") and np.isclose(x["log_prob"], max(a, b)) and np.isclose(x["margin"], abs(a - b), atol=1e-9)


def test_language_id_of_copies_and_unspaced_scripts(spark):
    han = "\u7684\u662f\u4e0d\u4e86\u5728\u4eba\u6709\u6211\u4ed6\u8fd9\u4e2a\u4eec\u4e2d\u6765\u4e0a\u5927\u4e3a\u548c\u56fd\u5730"
    r = random.Random(8)
    one = "\u3053\u308c\u306f\u79c1\u306e\u672c\u3067\u3059" * 6
    rows = [row(1, one, "ja")] * 3000 + [row(10_000 + i, "".join(r.choices(han, k=60)), "zh") for i in range(40)] + [row(20_000 + i, prose(i, 20), "xx") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, table = langid.fit(docs)
    assert langs == ["ja", "xx", "zh"] and all(c.max() > 20 * c.min() for c in table.T)
    fresh = spark.createDataFrame([row(i, "".join(r.choices(han, k=60)), None) for i in range(20)] + [row(50, one[:40], None)], SCHEMA)
    assert [x["predicted"] for x in sorted(got(langid.identify(fresh, model=(langs, table))), key=lambda x: x["doc_id"])] == ["zh"] * 20 + ["ja"]


def test_language_id_held_out(spark, none):
    fr, en = ["le", "chien", "dans", "maison", "avec", "rouge"], ["the", "dog", "house", "with", "under", "green"]
    r = random.Random(3)
    rows = [row(i, " ".join(r.choices(fr if i % 2 else en, k=30)), "fr" if i % 2 else "en") for i in range(60)]
    held = [(100 + i, " ".join(r.choices(fr if i % 2 else en, k=12)), None, "s", 1) for i in range(20)]
    out = got(langid.identify(spark.createDataFrame(rows + held + [row(None, None, None), row(200, "", None)], SCHEMA)))
    assert all(x["predicted"] == ("fr" if x["doc_id"] % 2 else "en") for x in out if x["doc_id"] is not None and x["doc_id"] < 150)
    assert all(x["predicted"] is None for x in out if x["doc_id"] in (None, 200)) and len(out) == 82
    assert got(langid.identify(none)) == []


def test_language_id_fits_every_language_and_long_words(spark):
    words = {f"l{k:02}": [prose(1000 * k + i, 1) + chr(0x430 + k % 32) * 3 + chr(0x3B1 + k // 32) * 3 for i in range(4)] for k in range(70)}
    rows = [row(100 * k + i, " ".join(w), lang) for k, (lang, w) in enumerate(sorted(words.items())) for i in range(2 if k >= 66 else 3)]
    langs, table = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert langs == sorted(words) and table.shape[1] == 70
    out = got(langid.identify(spark.createDataFrame(rows, SCHEMA), model=(langs, table)))
    assert len(out) == len(rows) and all(x["predicted"] == x["lang"] for x in out if x["lang"] >= "l64")
    flat = langid.fit_pieces([], np.zeros(0, np.int64), langid.VOCABULARY)
    long = langid.fit_pieces(["的是不了在人有我他这" * 8], np.array([5]), langid.VOCABULARY)
    assert not np.allclose(flat, long) and long.max() > 100 * flat.max()


def brute_compression(rows, known, size=None):
    """Words counted, ranked and joined, segments counted and taken out, in plain Python."""
    good = {i for i, q, _ in known if i is not None and q == 1}
    texts = [(i, t.encode()) for i, t, *_ in rows if t]
    every = [w.decode() for _, t in texts for w in re.findall(rb"[^ \t\n\r\x0b\x0c]+", t)]
    size = size or lmscore.dictionary_bytes(sum(len(w.encode()) for w in every))

    def dictionary(words):
        counts = Counter(w[k : k + lmscore.RUN] for w in words for k in range(0, len(w), lmscore.RUN))
        out = []
        for w in sorted((w for w in counts if len(w) >= lmscore.MIN_LETTERS), key=lambda w: (-counts[w] * (len(w.encode()) - 1), w.encode())):
            if sum(map(len, out)) + len(w.encode()) + 1 <= size:
                out.append(b" " + w.encode())
        return b"".join(reversed(out))

    dicts = dictionary([w.decode() for i, t in texts if i in good for w in t.split()]), dictionary(every)

    def cut(raw):
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
        h = common.word_hashes(np.frombuffer(raw, np.uint8), *(np.array(x, np.int64) for x in zip(*words))) if words else []
        out, first = [], 0
        for k in range(len(words)):
            if h[k] % np.uint64(lmscore.SEGMENT) == 0 or k + 1 == len(words):
                if k + 1 - first >= lmscore.LEAST_WORDS:
                    out.append((words[first][0], words[k + 1][0] if k + 1 < len(words) else len(raw), tuple(raw[a:b] for a, b in words[first : k + 1])))
                first = k + 1
        return out

    n, n_in = Counter(), Counter()
    for i, t in texts:
        own = {w for *_, w in cut(t)}
        n.update(own)
        n_in.update(own if i in good else ())
    out = Counter()
    for i, t, *_ in rows:
        if not t:
            out[i, None if t is None else 0, None, None] += 1
            continue
        raw, bits = t.encode(), []
        for side, d in enumerate(dicts):
            spans = [(a, b) for a, b, w in cut(raw) if (n[w] > 1 if side else n_in[w] > (i in good))]
            rest = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
            bits.append(8 * (lmscore.REFERENCE * len(spans) + (len(lmscore.compressor(d).compress(rest)) if rest else 0)) / len(raw))
        out[i, len(raw), round(bits[0], 9), round(bits[1], 9)] += 1
    return out


def test_compression_scores(spark, docs, none, rows):
    known = [(i, i % 2, 0) for i in range(20, 50)] + [(None, 1, 1), (1, 1, 0), (5, 1, 0), (63, 0, 0)]
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    keys = ("doc_id", "n_bytes", "in_bits", "general_bits")
    out = got(lmscore.scores(docs, labels))
    assert Counter(tuple(round(x[k], 9) if isinstance(x[k], float) else x[k] for k in keys) for x in out) == brute_compression(rows, known)
    assert all(x["score"] is None if not x["n_bytes"] else np.isclose(x["score"], x["general_bits"] - x["in_bits"]) for x in out)
    alike = {x["doc_id"]: x for x in out}
    assert alike[1]["general_bits"] < 0.2 * alike[40]["general_bits"] and alike[2]["in_bits"] < 0.2 * alike[40]["in_bits"]
    dicts = lmscore.dictionaries(docs, labels)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dicts[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    sample = rows[0][1].encode()
    assert plain.decompress(lmscore.compressor(dicts[1]).compress(sample), max_output_size=len(sample)) == sample
    assert got(lmscore.scores(none, labels)) == []


def test_compression_dictionary_survives_words_of_any_length(spark, labels):
    rows = [row(1, "x" * 70_000), row(2, "\u7684\u662f\u4e0d" * 30_000)] + [row(i, prose(i, 300)) for i in range(20, 50)]
    for d in lmscore.dictionaries(spark.createDataFrame(rows, SCHEMA), labels, 1000):
        assert 980 < len(d) <= 1000
    words = pa.table({"word": ["y" * 5000, "abc", "abcd"], "v": [9, 8, 7]})
    assert lmscore.assemble(words, 600) == b" abcd abc"


def test_compression_dictionary_grows_and_is_all_reached(spark, docs, labels):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=11)) for _ in range(200_000)]
    many = spark.createDataFrame([row(i, " ".join(words[i * 1000 : i * 1000 + 1000] * 40)) for i in range(200)], SCHEMA)
    good = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    inside, general = lmscore.dictionaries(many, good)
    assert len(general) > lmscore.DICTIONARY_BYTES + 20_000 and len(inside) > lmscore.DICTIONARY_BYTES + 20_000
    assert general.decode().split()[::-1] == sorted(set(words))[: len(general) // 12]
    assert inside.decode().split()[::-1] == sorted(set(words[:100_000]))[: len(inside) // 12]
    assert all(580 < len(d) <= 600 for d in lmscore.dictionaries(docs, labels, 600))
    large = "".join(" " + w for w in words).encode()  # 2.4 MB; whichever part of it a text is made of, it costs little
    for i in (0, 100_000, 199_000):
        raw = " ".join(r.sample(words[i : i + 1000], 200)).encode()
        assert len(lmscore.compressor(large).compress(raw)) < 0.35 * len(raw)


def toxic_corpus():
    r = random.Random(5)
    bad = ["vornak", "vornaks", "vornakig", "idiot", "stupid", "trash"]
    rows, truth = [], []
    for i in range(400):
        words = prose(10_000 + i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for w in r.sample(bad, 4):
                words.insert(r.randrange(60), w)
        rows.append(row(i, " ".join(words)))
        truth.append(toxic)
    return rows, truth


def test_toxicity_finds_toxic_and_leaves_clean(spark, none, labels):
    rows, truth = toxic_corpus()
    known = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(200)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    odd = [row(None, "idiot stupid"), row(900, None), row(901, "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    out = got(toxicity.judged(docs, known))
    held = [(x["toxic"], truth[x["doc_id"]]) for x in out if x["doc_id"] is not None and 200 <= x["doc_id"] < 400]
    assert sum(a for a, b in held if b) >= 0.9 * sum(b for _, b in held) and not any(a for a, b in held if not b)
    assert len(out) == 403 and next(x for x in out if x["doc_id"] == 900)["score"] is None
    assert docs.count() - toxicity.clean(docs, known).count() == sum(x["toxic"] for x in out)
    assert got(toxicity.judged(none, labels)) == []


def test_toxicity_where_most_is_toxic_and_nulls_stay(spark):
    r = random.Random(6)
    bad = ["vornak", "vornaks", "vornakig", "idiot", "stupid", "trash"]
    rows = []
    for i in range(400):
        words = prose(20_000 + i, 40).split()
        for w in r.sample(bad, 4) if i % 5 < 3 else ():
            words.insert(r.randrange(40), w)
        rows.append(row(i, " ".join(words)))
    known = spark.createDataFrame([(i, 1, int(i % 5 < 3)) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([*rows, row(900, None), row(901, ""), row(902, None)], SCHEMA)
    assert 0.5 < toxicity.fit(docs, known).labels.prior < 0.7
    out = {x["doc_id"]: x["toxic"] for x in got(toxicity.judged(docs, known))}
    assert sum(out[i] == (i % 5 < 3) for i in range(200, 400)) >= 195
    assert {x["doc_id"] for x in got(toxicity.clean(docs, known))} == {i for i, t in out.items() if not t} and not out[900]


def test_toxicity_query_by_brute_force(spark):
    """Votes and scores of each text, read word by word, under the fitted model."""
    rows, truth = toxic_corpus()
    rows = [*rows, row(500, "Idiot! (trash) vornakig-stupid, you"), row(501, "\u201cVORNAKS\u201d x"), row(502, "")]
    known = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, known)
    lists = (model.mined, model.stems, model.twice, model.innocent)
    patterns, want = Counter(), {}
    for i, t, *_ in rows:
        hits, words = [], set()
        for place, run in enumerate(t.split()):
            for w in toxicity.LETTERS.findall(run.lower()):
                words.add(w)
                if b := toxicity.bits_of(w, *lists):
                    hits.append((place, b, w))
        pattern, n = toxicity.votes(hits, model.twice)
        patterns[pattern] += 1
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(words))
        want[i] = (n, round(model.posteriors[pattern], 9), round(1 / (1 + np.exp(-z)), 9))
    assert {x["doc_id"]: (x["n_hits"], round(x["posterior"], 9), round(x["score"], 9)) for x in got(toxicity.judged(docs, known, model=model))} == want
    again = toxicity.fit_labels(sorted(patterns), [patterns[p] for p in sorted(patterns)])
    assert np.isclose(again.prior, model.labels.prior, atol=0.02) and abs(model.labels.prior - sum(truth) / 400) < 0.02


def test_label_model_estimates_accuracies_and_correlations():
    """Votes drawn from the model itself, three of the voters being one and the same."""
    rng = np.random.default_rng(2)
    m, n = len(toxicity.VOTERS), 40_000
    label = rng.random(n) < 0.3
    right = np.array([0.9, 0.8, 0.85, 0.75, 0.9, 0.9, 0.9, 0.8, 0.85, 0.9, 0.95, 0.8])
    v = np.where(rng.random((n, m)) < right, np.where(label, 1, 2)[:, None], np.where(label, 2, 1)[:, None])
    v[rng.random((n, m)) < 0.4] = 0
    v[:, 5] = v[:, 6] = v[:, 4]
    packed = Counter((v << 2 * np.arange(m)).sum(axis=1).tolist())
    model = toxicity.fit_labels(list(packed), list(packed.values()))
    assert abs(model.prior - 0.3) < 0.03 and np.abs(model.accuracy - right).max() < 0.06
    assert model.correlation[4, 5] > 0.9 and model.correlation[5, 6] > 0.9 and model.correlation[0, 1] < 0.1
    assert ((model.posterior(v) > 0.5) == label).mean() > 0.95


def test_label_model_discounts_copies_of_a_voter():
    m = len(toxicity.VOTERS)
    model = toxicity.LabelModel(0.1, np.full(m, 0.8), np.zeros((m, m)))
    votes = np.zeros((1, m), int)
    votes[0, :3] = toxicity.TOXIC
    tied = np.zeros((m, m))
    tied[:3, :3] = 1 - np.eye(3)
    assert toxicity.LabelModel(0.1, np.full(m, 0.8), tied).posterior(votes)[0] < model.posterior(votes)[0]


def brute_paragraphs(text):
    out, held = [], []
    for line in text.lower().split("\n"):
        line = line.strip(" \t\r\x0b\x0c")
        if line:
            held.append(line)
        if held and (not line or line[-1] in ".!?:;"):
            out.append(held)
            held = []
    return [" ".join(p) for p in out + ([held] if held else [])]


def test_license_scan_query_by_brute_force(spark, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."
    odd = "\n\nfirst line\ngoes on: \n\t\nLicensed under\nthe MIT License\n \n\u201cquoted\u201d \u2014 text\u2026\nend"
    rows = [row(1, prose(1, 80) + "\n\n" + mit), row(2, prose(2, 200)), row(3, ""), row(4, None), row(None, mit), row(5, "Licensed under the Apache License, Version 2.0."), row(6, odd), row(7, " \n\n "), row(5, "Licensed under the Apache License, Version 2.0.")]
    rows += [row(i, prose(i, 100)) for i in range(30, 80)] + [row(90, ".\n".join(prose(i, 12) for i in range(900)) + ".\n" + mit)]
    rows += [row(100 + k, prose(k, 20) + ".\n" + c) for k, c in enumerate(x for f in licenses.CLAUSES for x in licenses.CLAUSES[f][:1])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = licenses.fit(licenses.ordinary_paragraphs(docs))
    want = Counter()
    for i, t, *_ in rows:
        parts, found = brute_paragraphs(t or ""), []
        for k, part in enumerate(parts):
            p = model.probabilities(licenses.tokens(part))
            if model.families[p.argmax()] != licenses.UNKNOWN and p.max() >= licenses.THRESHOLD:
                found.append((k, model.families[p.argmax()], round(float(p.max()), 6)))
        best = max(found, key=lambda f: (f[2], -f[0]), default=(None, None, None))
        want[i, None if t is None else len(parts), best[1], tuple(found)] += 1
    out = got(licenses.scan(docs))
    assert Counter((x["doc_id"], x["n_paragraphs"], x["license"], tuple((f["paragraph"], f["license"], round(f["probability"], 6)) for f in x["found"])) for x in out) == want
    by = {x["doc_id"]: x for x in out}
    assert by[1]["license"] == "MIT" and by[1]["confirmed"] and by[6]["license"] == "MIT" and by[90]["license"] == "MIT" and by[90]["found"][0]["paragraph"] == 900
    assert by[5]["license"] == "Apache-2.0" and by[2]["license"] is None and by[4]["n_paragraphs"] is None and by[3]["n_paragraphs"] == by[7]["n_paragraphs"] == 0
    assert all(by[i]["license"] is None for i in range(30, 80)) and got(licenses.scan(none)) == []
    assert all(by[100 + k]["license"] == f and by[100 + k]["confirmed"] for k, f in enumerate(licenses.CLAUSES))


def test_license_paragraphs_like_line_by_line():
    r = random.Random(7)
    for _ in range(300):
        texts = ["".join(r.choice(["a", "b c", ".", "\n", "\n", " ", ":", "\t", "\u00e9"]) for _ in range(r.randint(0, 14))) for _ in range(4)]
        raw, off = licenses.normal(pa.array([*texts, None]))
        row_, a, b = licenses.spans(raw, off)
        mine = [(i, " ".join(x.strip(" \t\r") for x in raw[p:q].tobytes().decode().split("\n")).strip()) for i, p, q in zip(row_.tolist(), a.tolist(), b.tolist())]
        assert mine == [(i, p) for i, t in enumerate(texts) for p in brute_paragraphs(t)]


def test_token_counts_equal_whole_encoding(docs, rows, none):
    encoding, _ = tokencount.encoder(tokencount.VOCABULARY)
    small = got(tokencount.counts(docs, chunk_chars=900, overlap_chars=60))
    want = Counter((i, None if t is None else len(encoding.encode_ordinary(t))) for i, t, *_ in rows)
    assert Counter((x["doc_id"], x["n_tokens"]) for x in small) == want
    assert max(x["n_chunks"] or 0 for x in small) > 20 and got(tokencount.counts(none)) == []
    for text in ("a" * 5000, " " * 3000 + "x", "1234567890" * 400, "\U0001f600" * 900):
        assert tokencount.encode_long(text, tokencount.VOCABULARY, 700, 20)[0] == encoding.encode_ordinary(text)


def brute_repeats(rows, window):
    seen, marks = {}, defaultdict(set)
    known = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    for i, t in known:
        w = [x for x in t.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if seen.setdefault(key, (i, t, k)) != (i, t, k):
                marks[i, t].update(range(k, k + window))
    out = set()
    for (i, _), at in marks.items():
        at = sorted(at)
        start = prev = at[0]
        for x in [*at[1:], None]:
            if x is None or x > prev + 1:
                out.add((i, start, prev + 1))
                start = x
            prev = x
    return out


def test_suffix_array_dedup(spark, docs, rows, none, clashing):
    out = {(x["doc_id"], x["start_word"], x["end_word"]) for x in got(suffixdedup.repeated_spans(docs))}
    assert out == brute_repeats(rows, 50)
    assert {(x["doc_id"], x["start_word"], x["end_word"]) for x in got(suffixdedup.repeated_spans(clashing))} == out
    again = suffixdedup.without_repeats(docs)
    assert again.columns == docs.columns and not got(suffixdedup.repeated_spans(again)) and got(suffixdedup.repeated_spans(none)) == []
    r = random.Random(1)
    dense = [row(i, " ".join(r.choice("ab") for _ in range(40))) for i in range(12)]
    for hot in (1, 10, 10**6):
        assert {tuple(x.values()) for x in got(suffixdedup.repeated_spans(spark.createDataFrame(dense, SCHEMA), 6, 3, hot))} == brute_repeats(dense, 6)


@pytest.mark.parametrize("hot,kept", [(20, 5), (20, 200_000), (10**6, 5), (10**6, 200_000)])
def test_suffix_array_dedup_of_a_gram_in_every_document(spark, monkeypatch, hot, kept):
    """Boilerplate in all documents, alone, in front of other words, and as a whole text, however it is spread."""
    monkeypatch.setattr(suffixdedup, "KEPT", kept)
    footer, head = prose(77, 60), prose(78, 30)
    rows = [row(i, (head + " " if i % 3 == 0 else "") + prose(3000 + i, 30) + " " + footer) for i in range(300)] + [row(500 + i, footer) for i in range(40)] + [row(600, footer + " " + footer)] * 2
    rows += [row(700 + i, head + " " + prose(4000 + i % 7, 45)) for i in range(60)]
    out = {tuple(x.values()) for x in got(suffixdedup.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), hot=hot))}
    assert out == brute_repeats(rows, 50)


def test_deep_shallow_sorts_like_sorted():
    r = random.Random(2)
    keys = [bytes(r.choice(b"\1\2") for _ in range(24)) for _ in range(200)] + [b"\1" * 24] * 20
    pairs = suffixdedup.deep_shallow(keys, list(range(len(keys))))
    assert [keys[i] for i, _ in pairs] == sorted(keys)
    assert all(c == suffixdedup.lcp(keys[a], keys[b]) for (a, _), (b, c) in zip(pairs, pairs[1:]))


class PlainBestFit:
    """Open bins in a list, looked through one by one."""

    def __init__(self, capacity, most, first):
        self.capacity, self.most, self.made, self.bins, self.turn = capacity, most, first, [], 0

    def add(self, n):
        self.turn += 1
        if n == self.capacity:
            self.made += 1
            return self.made - 1, 0
        fits = [b for b in self.bins if self.capacity - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (self.capacity - b[1], b[2]))
        else:
            if len(self.bins) == self.most:
                self.bins.remove(max(self.bins, key=lambda b: (b[1], -b[2])))
            b, self.made = [self.made, 0, 0], self.made + 1
            self.bins.append(b)
        at = b[1]
        b[1], b[2] = b[1] + n, self.turn
        if b[1] == self.capacity:
            self.bins.remove(b)
        return b[0], at


def test_packing_query_by_brute_force(spark, docs):
    from pyspark.sql import functions as F

    sized = [(x["doc_id"], x["n_tokens"] or 0) for x in got(tokencount.counts(docs))]
    shards = -(-len(sized) // 10)
    keyed = spark.createDataFrame(sized, "doc_id bigint, n bigint").withColumn("s", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)))
    want, packers = Counter(), {}
    for x in sorted(got(keyed), key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["n"])):
        p = packers.setdefault(x["s"], PlainBestFit(300, 3, x["s"] << 32))
        if not x["n"]:
            want[x["doc_id"], 0, 0, None, None] += 1
        for piece, at in enumerate(range(0, x["n"], 300)):
            n = min(300, x["n"] - at)
            want[(x["doc_id"], piece, n, *p.add(n))] += 1
    assert Counter(tuple(x.values()) for x in got(packing.pack(docs, capacity=300, open_bins=3, shard_rows=10))) == want


def test_packing_is_online_best_fit(docs, none):
    out = got(packing.pack(docs, capacity=300, open_bins=3, shard_rows=10))
    full = Counter()
    spans = defaultdict(list)
    for x in out:
        if x["bin_id"] is not None:
            full[x["bin_id"]] += x["n_tokens"]
            spans[x["bin_id"]].append((x["bin_offset"], x["n_tokens"]))
    assert max(full.values()) <= 300
    assert all(b[0] == a[0] + a[1] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    sizes = Counter((x["doc_id"], x["n_tokens"] or 0) for x in got(tokencount.counts(docs)))
    assert sum(n * k for (_, n), k in sizes.items()) == sum(x["n_tokens"] for x in out) and got(packing.pack(none)) == []
    r = random.Random(4)
    p, bins, made = packing.Packer(100, 4), [], 0
    for _ in range(500):
        n = r.randint(1, 100)
        if n == 100:  # a bin of its own, which closes none
            assert p.add(n) == (made, 0)
            made += 1
            continue
        fits = [b for b in bins if 100 - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (100 - b[1], b[2]))
        else:
            if len(bins) == 4:
                bins.remove(max(bins, key=lambda b: (b[1], -b[2])))
            b, made = [made, 0, 0], made + 1
            bins.append(b)
        assert p.add(n) == (b[0], b[1])
        b[1], b[2] = b[1] + n, _ + 1
        if b[1] == 100:
            bins.remove(b)


def brute_groups(rows):
    """All pairs of different texts, by SimHash distance and the similarity of their sketches."""
    known = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None and words_of(t)})
    raw, off = common.buffers(pa.array([t.lower() for _, t in known]))
    _, hi, lo, _, sketch = simhashgraph.signatures(raw, off)
    codes = np.stack([hi, lo], axis=1).view(np.uint64)
    part = list(range(len(known)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if simhashgraph.hamming(codes[a], codes[b]) <= simhashgraph.RADIUS and simhashgraph.jaccard(sketch[a : a + 1], sketch[b : b + 1])[0] >= simhashgraph.SIMILARITY:
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {k: known[find(n)][0] for n, k in enumerate(known)}


def test_simhash_groups_by_brute_force(spark, docs, rows, none, clashing):
    r = random.Random(9)
    more = []
    for i in range(60):
        words = prose(50_000 + i % 12, 150).split()
        for k in r.sample(range(150), r.choice((0, 1, 3, 8, 20, 60))):
            words[k] = r.choice("xyz")
        more.append(row(2000 + i, " ".join(words)))
    crowd = prose(60_000, 180).split()
    more += [row(3000 + i, " ".join([*crowd[:i], f"w{i}", *crowd[i + 1 :]])) for i in range(60)]
    whole = [*rows, *more]
    want = brute_groups(whole)
    out = got(simhashgraph.groups(spark.createDataFrame(whole, SCHEMA).repartition(4), shards=3))
    assert {x["doc_id"]: x["group_id"] for x in out if x["doc_id"] in {i for i, _ in want}} == {i: g for (i, _), g in want.items()} and len(out) == len(whole)
    size = Counter(want.values())
    assert all(x["group_size"] == size.get(x["group_id"], 1) and x["kept"] == (x["group_id"] == x["doc_id"]) for x in out if x["doc_id"] is not None)
    group = {x["doc_id"]: x["group_id"] for x in got(simhashgraph.groups(docs))}
    assert group[1] == group[2] == group[3] == 1 and all(group[i] == i for i in (4, 5, 7, 60, 61, *range(20, 50)))
    assert {x["doc_id"]: x["group_id"] for x in got(simhashgraph.groups(clashing))} == group
    kept = Counter(x["doc_id"] for x in got(simhashgraph.first_of_each(docs)))
    assert kept[1] == 1 and not kept[2] and not kept[3] and kept[4] == 1 and kept[61] == 1 and kept[None] == 1
    assert got(simhashgraph.groups(none)) == []


def nodes_of_few_values():
    """Nodes whose codes are close to each other and whose slots have three values each, so every slot value is a crowd
    and hardly any node is similar to the one that stands for it; single nodes; chains of pairs just similar enough."""
    rng = np.random.default_rng(12)
    some = rng.choice(3, (150, simhashgraph.SLOTS), p=(0.5, 0.3, 0.2)).astype(np.uint16)
    other = rng.integers(10, 60_000, (200, simhashgraph.SLOTS)).astype(np.uint16)
    other[:, 100:][rng.random((200, 28)) < 0.5] = simhashgraph.EMPTY
    for i in range(1, 100):
        filled = np.flatnonzero(other[i - 1] != simhashgraph.EMPTY)
        other[i] = np.where(other[i - 1] == simhashgraph.EMPTY, simhashgraph.EMPTY, other[i])
        kept = rng.choice(filled, -(-len(filled) // 2) - i % 2, replace=False)
        other[i][kept] = other[i - 1][kept]
    sketch = np.concatenate([some, other])
    base = rng.integers(0, 2, (1 + 20, 128)).astype(np.uint8)
    bits = base[np.concatenate([np.zeros(150, int), 1 + np.arange(200) // 10])].copy()
    for b in bits:
        b[rng.choice(128, 11, replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64), sketch


def test_simhash_join_loses_no_link(spark):
    codes, sketch = nodes_of_few_values()
    n = len(codes)
    a, b = np.triu_indices(n, 1)
    links = (simhashgraph.hamming(codes[a], codes[b]) <= 22) & (simhashgraph.jaccard(sketch[a], sketch[b]) >= 0.5)
    part = simhashgraph.Union(n)
    part.join(a[links], b[links])
    want = {i: int(r) for i, r in enumerate(part.roots(np.arange(n)))}
    rows = [(i, *codes[i].view(np.int64).tolist(), sketch[i].tobytes()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint, sketch binary").repartition(5)
    for shards, slots in ((3, 500_000), (1, 700)):
        root = {x["node"]: x["root"] for x in got(simhashgraph.linked(nodes, shards=shards, shard_slots=slots))}
        assert {i: root.get(i, i) for i in range(n)} == want
    assert 20 < len(set(want.values())) < n - 20 and links[a < 150].sum() > 10
    assert got(simhashgraph.linked(nodes.limit(0))) == []
    with pytest.raises(ValueError):
        simhashgraph.linked(nodes, similarity=0)


def test_simhash_crowds_apart_send_links_only(spark, monkeypatch):
    """What is left of crowds that their leaders do not unite is verified block by block: the links are those of all
    pairs, and no more of them than nodes and tiles, where the pairs within the radius are as many as all pairs."""
    codes, sketch = nodes_of_few_values()
    codes, sketch = codes[:150], sketch[:150]
    sketch[:, 64:] = np.arange(150 * 64).reshape(150, 64) + 10  # half of the slots are each node's own: hardly any links
    sketch[100:, 64:] = sketch[99, 64:]
    n = len(codes)
    a, b = np.triu_indices(n, 1)
    within = simhashgraph.hamming(codes[a], codes[b]) <= 22
    links = within & (simhashgraph.jaccard(sketch[a], sketch[b]) >= 0.5)
    part = simhashgraph.Union(n)
    part.join(a[links], b[links])
    want = part.roots(np.arange(n)).tolist()
    assert within.all() and 20 < len(set(want)) < n - 20
    asked, similar = [], simhashgraph.similar

    def counted(pairs, *rest):
        asked.append(pairs.distinct().count())
        return similar(pairs, *rest)

    monkeypatch.setattr(simhashgraph, "similar", counted)
    rows = [(i, *codes[i].view(np.int64).tolist(), sketch[i].tobytes()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint, sketch binary").repartition(5)
    root = {x["node"]: x["root"] for x in got(simhashgraph.linked(nodes))}
    assert [root.get(i, i) for i in range(n)] == want
    assert sum(asked) < n * (n - 1) // 4
    for block in (1000, 40, 7):
        members = spark.createDataFrame([(slot, *r[:3], r[0]) for r in rows for slot in (3, 5)], "slot bigint, node bigint, hi bigint, lo bigint, root bigint")
        found = got(simhashgraph.rest_of_crowds(members, nodes, 22, 0.5, block))
        part = simhashgraph.Union(n)
        part.join(np.array([x["a"] for x in found]), np.array([x["b"] for x in found]))
        assert part.roots(np.arange(n)).tolist() == want
        assert block < 1000 or len(found) == 2 * (n - len(set(want)))
        assert len({tuple(x) for x in map(tuple, ((x["a"], x["b"]) for x in found))} - set(zip(b[links].tolist(), a[links].tolist()))) == 0
    assert got(simhashgraph.rest_of_crowds(members.withColumn("root", members.slot), nodes, 22, 0.5, 40)) == []


def test_simhash_work_in_proportion():
    """A node goes out once for each of its rarest slots, however many shards there are; a crowd gives one candidate a
    node and not all of its pairs."""
    codes, sketch = nodes_of_few_values()
    times = np.zeros(simhashgraph.SLOTS << 16, np.uint16)
    for similarity, most in ((0.5, 65), (0.9, 13)):
        rows, _ = simhashgraph.rarest(sketch, times, similarity)
        assert np.bincount(rows).max() <= most and np.bincount(rows).min() >= 1
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(codes))), *(pa.array(codes[:, k].view(np.int64)) for k in (0, 1)), pa.array([x.tobytes() for x in sketch])], names=["node", "hi", "lo", "sketch"]
    )
    sent = lambda shards: sum(len(x) for out in simhashgraph._send(SimpleNamespace(value=times), 0.5, shards)([batch]) for x in out.column("data").to_pylist())
    assert sent(1) == sent(8) == sent(64)
    for m in (500, 4000):
        entries = np.zeros(m, simhashgraph.ENTRY)
        entries["node"] = np.arange(m)
        pairs, crowds = simhashgraph.meetings(entries, 22)
        assert len(pairs) == m - 1 and [len(c) for c in crowds] == [m]
    few = np.zeros(6, simhashgraph.ENTRY)
    few["node"], few["slot"], few["code"][3] = np.arange(6), [1, 1, 1, 1, 2, 2], 2**64 - 1
    pairs, crowds = simhashgraph.meetings(few, 22)
    assert pairs.tolist() == [[0, 1], [0, 2], [1, 2], [4, 5]] and not crowds


def test_one_verified_pair_a_query_and_part():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (40, simhashgraph.SLOTS)).astype(np.uint16), rng.integers(0, 3, (60, simhashgraph.SLOTS)).astype(np.uint16)
    q, p = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(60), indexing="ij"))
    part = (p * 7) % 11
    good = simhashgraph.jaccard(a[q], b[p]) >= 0.4
    x, y = simhashgraph.verified(q, p, part, a, b, 0.4)
    assert set(zip(q[good].tolist(), part[good].tolist())) == set(zip(x.tolist(), ((y * 7) % 11).tolist())) and len(x) == len(set(zip(x.tolist(), ((y * 7) % 11).tolist())))
    assert (np.diff(x) >= 0).all() and (simhashgraph.jaccard(a[x], b[y]) >= 0.4).all()
    u = simhashgraph.Union(6)
    assert u.join(np.array([0, 1, 2, 3, 0]), np.array([1, 2, 0, 4, 1])).tolist() == [0, 1, 3] and u.roots(np.arange(6)).tolist() == [0, 0, 0, 3, 3, 5]


def test_simhash_texts_that_share_a_doc_id_are_apart(spark):
    rows = [row(1, prose(1, 90)), row(2, prose(1, 90)), row(2, prose(2, 90)), row(3, prose(3, 90)), row(3, prose(3, 90)), row(4, "...")]
    out = Counter((x["doc_id"], x["group_id"], x["kept"]) for x in got(simhashgraph.groups(spark.createDataFrame(rows, SCHEMA))))
    assert out == Counter({(1, 1, True): 1, (2, 1, False): 1, (2, 2, True): 1, (3, 3, True): 2, (4, 4, True): 1})
    left = Counter((x["doc_id"], x["text"]) for x in got(simhashgraph.first_of_each(spark.createDataFrame(rows, SCHEMA))))
    assert left == Counter({(1, prose(1, 90)): 1, (2, prose(2, 90)): 1, (3, prose(3, 90)): 1, (4, "..."): 1})


def test_simhash_many_copies_and_guards(spark):
    rows = [row(i, prose(5, 40) + (" ." if i % 2 else "")) for i in range(5000)] + [row(9000, prose(6, 40))]
    out = Counter((x["group_id"], x["group_size"]) for x in got(simhashgraph.groups(spark.createDataFrame(rows, SCHEMA).repartition(6))))
    assert out == Counter({(0, 5000): 5000, (9000, 1): 1})
    with pytest.raises(ValueError):
        simhashgraph.candidate_edges(None, shard_points=1 << 23)


def test_small_world_recall():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (3000, 2), dtype=np.uint64)
    crowd = np.repeat(base[:1], 400, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (400, 2)).astype(np.uint64))
    flips = base[1:1001] ^ (np.uint64(1) << rng.integers(0, 63, (1000, 2)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, (1000, 2)).astype(np.uint64))
    codes = np.unique(np.concatenate([base, crowd, flips]), axis=0)
    g = simhashgraph.SmallWorld(codes)
    q = codes[:800]
    truth = g.exact(q, 22)
    for beam in (12, 24, 96):
        a, b = g.search(q, beam, 22)
        pairs = set(zip(a.tolist(), b.tolist()))
        assert pairs <= truth and len(pairs) >= 0.96 * len(truth) and len(a) == len(pairs)
    assert len(simhashgraph.SmallWorld(codes[:1]).search(codes[:5], 12, 22)[0]) >= 1


def test_audit_sees_foreign_queries_and_small_groups(monkeypatch):
    rng = np.random.default_rng(4)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 63, x.shape).astype(np.uint64))
    base = rng.integers(0, 2**63, (2000, 2), dtype=np.uint64)
    crowd = np.unique(flip(np.repeat(base[:1], 400, axis=0)), axis=0)
    points = np.unique(np.concatenate([base[1:], crowd, flip(base[1000:1100])]), axis=0)
    g = simhashgraph.SmallWorld(points)
    foreign = np.concatenate([flip(base[1:600]), rng.integers(0, 2**63, (50, 2), dtype=np.uint64)])
    (queries, truth), (crowded, _) = g.truth(np.concatenate([crowd[:300], foreign]), 22, 500, 10_000)
    assert 0 < len(crowded) < 20 and len(queries) >= 450 and not {x.tobytes() for x in queries} & {x.tobytes() for x in crowd}
    assert {q for q, _ in truth} == set(range(len(queries)))
    whole = simhashgraph.SmallWorld.search

    def lossy(self, queries, beam, radius):
        """Small beams find nothing for queries that are no points of the graph, and only part of the rest."""
        q, p = whole(self, queries, beam, radius)
        known = (simhashgraph.hamming(queries[q], self.codes[np.argsort(self.names)[p]]) == 0)
        own = np.isin(q, q[known])
        keep = own | (beam >= 48)
        return q[keep], p[keep]

    monkeypatch.setattr(simhashgraph.SmallWorld, "search", lossy)
    assert g.audited_beam([points, foreign], 22)[0] >= 48
    assert g.audited_beam([points], 22)[0] < 48

    def no_pairs(self, queries, beam, radius):
        """Small beams lose every group but the crowd."""
        q, p = whole(self, queries, beam, radius)
        keep = (np.bincount(q, minlength=len(queries))[q] >= simhashgraph.BEAM) | (beam >= 48)
        return q[keep], p[keep]

    monkeypatch.setattr(simhashgraph.SmallWorld, "search", no_pairs)
    assert g.audited_beam([points, foreign[:0]], 22)[0] >= 48


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 40)] + [(101, 100)], "a bigint, b bigint")
    assert {x["node"]: x["root"] for x in got(simhashgraph.components(edges))} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_syncmers(docs, rows, none):
    k, s = syncmers.KMER, syncmers.SMER
    want = Counter()
    for i, t, *_ in rows:
        if not t or len(t) > 30_000:
            continue
        c = [ord(x) for x in t]
        h = [sum(c[p + j] * int(syncmers.COEFFICIENTS[j]) for j in range(s)) % 2**64 for p in range(len(c) - s + 1)]
        for p in range(len(c) - k + 1):
            inner = h[p : p + k - s + 1]
            if min(inner) in (inner[0], inner[-1]):
                want[i, p] += 1
    out = Counter((x["doc_id"], x["pos"]) for x in got(syncmers.fingerprints(docs)) if x["doc_id"] != 63)
    assert out == want and got(syncmers.fingerprints(none)) == []
    pairs = {(x["doc_a"], x["doc_b"]): x["n_anchors"] for x in got(syncmers.matches(docs))}
    assert (1, 2) in pairs and (5, 7) in pairs
    t = {i: t for i, t, *_ in rows}
    for x in got(syncmers.fingerprints(docs.where("doc_id IN (1, 5, 64)"))):  # the value, from the characters alone
        c = [ord(y) for y in t[x["doc_id"]][x["pos"] : x["pos"] + k]]
        h = [sum(c[p + j] * int(syncmers.COEFFICIENTS[j]) for j in range(s)) % 2**64 for p in range(k - s + 1)]
        assert x["anchor"] == sum((2 * p + 1) * y for p, y in enumerate(h)) % 2**64 // 2


def words_of(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def brute_contaminated(rows, items, least):
    out = set()
    for item, text in items:
        w = words_of(text or "")
        if item is None or len(w) < 3:
            continue
        bag = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        weight = lambda b: sum(n * sum(map(lambda x: len(x.encode()), g)) for g, n in b.items())
        for i, t, *_ in rows:
            d = words_of(t or "")
            if i is None or len(d) < 3:
                continue
            n = min(len(w), len(d))
            for k in range(len(d) - n + 1):
                if not any(tuple(d[j : j + 3]) in bag for j in range(k, k + n - 2)):
                    continue
                own = Counter(tuple(d[j : j + 3]) for j in range(k, k + n - 2))
                both = weight(own & bag)
                if both / (weight(own) + weight(bag) - both) >= least:
                    out.add((i, item))
    return out


def test_decontamination(spark, docs, rows, benchmark, none, clashing):
    items = [(x["item_id"], x["text"]) for x in got(benchmark)]
    out = {(x["doc_id"], x["item_id"]) for x in got(decontam.contaminated(docs, benchmark))}
    assert out == brute_contaminated(rows, items, decontam.SIMILARITY) == {(25, 1)}
    kept = Counter(x["doc_id"] for x in got(decontam.clean(docs, benchmark)))
    assert not kept[25] and sum(kept.values()) == len(rows) - 1
    assert len(got(decontam.clean(clashing, benchmark))) == len(rows) - 1
    assert got(decontam.contaminated(none, benchmark)) == [] and got(decontam.contaminated(docs, benchmark.limit(0))) == []


def test_decontamination_of_edited_items_and_long_documents(spark):
    r = random.Random(3)
    items = [(i, prose(9000 + i, 40)) for i in range(6)]
    rows = []
    for i, (_, text) in enumerate(items):
        for edits in (0, 2, 4, 8, 16):
            words = text.split()
            for k in r.sample(range(40), edits):
                words[k] = "edited"
            rows.append(row(100 * i + edits, prose(i, 1500 if edits == 2 else 25) + " " + " ".join(words) + " " + prose(50 + i, 25)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = {(x["doc_id"], x["item_id"]) for x in got(decontam.contaminated(spark.createDataFrame(rows, SCHEMA), bench))}
    truth = brute_contaminated(rows, items, decontam.SIMILARITY)
    assert out <= truth and len(out) >= 0.9 * len(truth) and len(truth) >= 12


def applied(name, docs, labels, benchmark):
    return {
        "langid": lambda: langid.identify(docs),
        "lmscore": lambda: lmscore.scores(docs, labels),
        "toxicity": lambda: toxicity.judged(docs, labels),
        "licenses": lambda: licenses.scan(docs),
        "tokencount": lambda: tokencount.counts(docs),
        "suffixdedup": lambda: suffixdedup.repeated_spans(docs),
        "packing": lambda: packing.pack(docs),
        "simhashgraph": lambda: simhashgraph.groups(docs),
        "syncmers": lambda: syncmers.fingerprints(docs),
        "decontam": lambda: decontam.contaminated(docs, benchmark),
        "toxic_out": lambda: toxicity.clean(docs, labels),
        "near_duplicates_out": lambda: simhashgraph.first_of_each(docs),
        "repeated_passages_out": lambda: suffixdedup.without_repeats(docs),
        "benchmark_out": lambda: decontam.clean(docs, benchmark),
    }[name]()


OPERATORS = ("langid", "lmscore", "toxicity", "licenses", "tokencount", "suffixdedup", "packing", "simhashgraph", "syncmers", "decontam")
FILTERS = ("toxic_out", "near_duplicates_out", "repeated_passages_out", "benchmark_out")
ROW_BY_ROW = ("langid", "lmscore", "toxicity", "licenses", "tokencount", "simhashgraph")


@pytest.mark.parametrize("name", OPERATORS + FILTERS)
def test_awkward_rows_and_clashing_names(name, spark, docs, rows, labels, benchmark, clashing):
    """Nulls, empty and very long texts, ties and repeated rows, with and without columns of clashing names; an empty
    table and one of a single row."""
    ours = docs.columns
    plainly = Counter(str(tuple(r)) for r in applied(name, docs, labels, benchmark).collect())
    among = applied(name, clashing, labels, benchmark)
    if name in FILTERS:
        assert among.columns == clashing.columns
        kept = Counter(str(tuple(r[: len(ours)])) for r in among.collect())
        assert all(r[len(ours) :] == (1,) * (len(clashing.columns) - len(ours)) for r in map(tuple, among.collect()))
        assert kept == plainly
        ids = Counter(r[0] for r in applied(name, docs, labels, benchmark).collect())
        assert ids[61] == 1 and ids[None] == 1 and ids[60] == 1 and ids[62] == 1 and ids[63] == 1
    else:
        assert Counter(str(tuple(r)) for r in among.collect()) == plainly
    if name in ROW_BY_ROW:
        assert sum(plainly.values()) == len(rows)
    assert applied(name, docs.limit(0), labels, benchmark).collect() == []
    one = spark.createDataFrame([row(1, "just one short text")], SCHEMA)
    assert applied(name, one, labels.limit(0), benchmark.limit(0)).count() == (0 if name in ("suffixdedup", "syncmers", "decontam") else 1)


def test_passages_of_which_only_white_space_is_left_go(spark):
    text = prose(5, 70)
    rows = [row(1, text), row(2, "\n\t" + text), row(3, " \n"), row(4, "word " + text), row(5, text + "\x0b")]
    assert [(x["doc_id"], x["text"], x["n_chars"]) for x in sorted(got(suffixdedup.without_repeats(spark.createDataFrame(rows, SCHEMA))), key=lambda x: x["doc_id"])] == [(1, text, len(text)), (3, " \n", 2), (4, "word ", 5)]
