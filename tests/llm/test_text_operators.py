"""Small cases for the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsweave.llm import contamination, disclosure, licence_scan, line_windows, packing, source_lists, textbytes, toxicity, vector_codes
from obsweave.llm.language import identify, train
from obsweave.llm.near_copies import near_copy_groups

OBS = "obs_id bigint, text string, id string, n int, h1 int, lang string"


def obs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "en") for i, t in rows], OBS)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_words_and_hashes_agree_with_regular_expressions():
    texts = ["A b  c\tÉd", "", "one", " lead and trail ", "x\ny\x0bz"]
    t = textbytes.Texts.of(pa.array([*texts, None]))
    start, end, before = t.words()
    got = [bytes(t.data[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert got == [w for x in texts for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
    assert list(np.diff(before)) == [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in texts] + [0]
    for width in (1, 2, 4):
        assert [len(s) for s in textbytes.shingle_sets(t, width)] == [len(shingles(x, width)) for x in [*texts, None]]


def test_near_copies_against_brute_force(spark):
    rnd, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(3, 70))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(9)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t "), (903, "Short Text"), (904, "short  text"), (905, "long " * 30000), (905, "long " * 30000), (None, "short text")]
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = near_copy_groups(obs(spark, rows), sketch_bits=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id is None) if r.obs_id is None else (r.n_shingles, r.component_id) == (len(sets[r.obs_id]), label[r.obs_id]), r
    assert near_copy_groups(obs(spark, [])).count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 190] + [f"n{i}"] + base[i % 190 + 1:])) for i in range(300)]
    assert {r.component_id for r in near_copy_groups(obs(spark, rows), sketch_bits=16).collect()} == {0}


def test_closest_fill_is_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        items, cap = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 9))], rnd.randrange(1, 60)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        counts = {x: items.count(x) for x in items}
        use = packing.closest_fill(counts, cap)
        assert all(n <= counts[x] for x, n in use.items())
        assert sum(x * n for x, n in use.items()) == max(s for s in sums if s <= cap)


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "Né à 12!"), (4, "Né à 12!"), (None, "no id"), (5, "<|endoftext|>\n\n  x"), (6, "word " * 700), (7, "hello <|endoftext|> world<|endoftext|><|endoftext|>!")]
    got = packing.pack_windows(obs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, window=512, group_texts=4, tokenizer_file=P.path("byte_bpe_50k.json")).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert 50256 in tok.encode("a<|endoftext|>", add_special_tokens=False).ids
    want = sorted((str(i), n) for i, t in rows for n in [len(tok.encode(t or "", add_special_tokens=False).ids) + 1])
    assert sum(r.length for r in got) == sum(n for _, n in want)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted({(r.start, r.length, bytes(r.ids)) for r in got if r.obs_id == i})
        if i != 4:
            assert np.frombuffer(b"".join(x[2] for x in mine), "<u4").tolist() == ids
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 512 or at & (at - 1) == 0
    assert packing.pack_windows(obs(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_rows_that_repeat_are_dealt_over_groups(spark):
    rows = [(1, "the same text")] * 4000 + [(None, None)] * 500 + [(i, f"text {i}") for i in range(2, 300)]
    got = packing.pack_windows(obs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, window=64, group_texts=400).collect()
    per_group = {}
    for r in got:
        per_group[r.sequence_id >> 32] = per_group.get(r.sequence_id >> 32, 0) + 1
    # pieces that a tail cuts count more than once
    assert len(per_group) > 6 and max(per_group.values()) < 1600
    assert sum(r.length for r in got if r.obs_id == 1) == 4000 * 4 and sum(r.length for r in got if r.obs_id is None) == 500


def test_line_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a \nb\n\nc\ny"), (3, None), (4, "a\nb"), (5, "z\nz\nz\nz\nz"), (6, ""), (7, "q\nr\ns"), (7, "q\nr\ns")]
    got = {r.obs_id: r for r in line_windows.drop_repeated_lines(obs(spark, rows)).collect()}
    assert (got[1].text, got[1].n_removed) == ("a\nb\nc\nd", 0)
    assert (got[2].text, got[2].n_removed) == ("x\n\ny", 3)
    assert (got[3].text, got[3].n_lines) == (None, 0) and got[4].text == "a\nb" and got[6].text == ""
    assert (got[5].text, got[5].n_removed) == ("z\nz\nz", 2)
    assert got[7].text == "q\nr\ns" and line_windows.drop_repeated_lines(obs(spark, [])).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_line_windows_of_texts_without_an_id_stay_apart(spark):
    for i in (None, 7):
        rows = [(i, "a\nb\nc\nown one\nown two"), (i, "a\nb\nc\nother one\nother two\nmore"), (i, "clean 1\nclean 2\nclean 3\nclean 4")]
        got = line_windows.drop_repeated_lines(obs(spark, rows)).collect()
        assert sorted(r.n_removed for r in got) == [0, 0, 3]
        left = {r.text for r in got}
        assert rows[2][1] in left and len(left & {rows[0][1], rows[1][1]}) == 1 and len(left & {"own one\nown two", "other one\nother two\nmore"}) == 1


def test_base_spans_are_those_of_the_expressions():
    rnd = random.Random(9)

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and disclosure.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    texts = ["a@b.c.d@e.f", "x@y@z.co", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "+49 (30) 1234-567 +1", "a.b@c-d.e%f@g.h"]
    texts += ["".join(rnd.choice("a1.@ +-(2%") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        want = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, t) if good(k, m[0])]
        assert disclosure.base_spans(t) == want, t
    for t in ("a" * 200000, "1" * 200000, "1." * 100000, "+1 " * 50000):
        disclosure.base_spans(t)


def test_terms_that_reveal_are_taken_out(spark):
    rows = [(i, f"the secret{'' if i % 2 else ' '} Zork writes from zork@mail.example.org the end") for i in range(6)]
    rows += [(100 + i, "the end of the matter is the mail") for i in range(200)] + [(400, None), (401, "")]
    got = {r.obs_id: r for r in disclosure.sanitise(obs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert "Zork" not in got[1].text_sanitised and "<email>" in got[1].text_sanitised and got[1].text_sanitised.startswith("the ")
    assert got[100].text_sanitised == rows[6][1] and got[400].text_sanitised == "" and not got[401].spans
    assert disclosure.personal_spans(obs(spark, [])).count() == 0


def test_what_one_text_says_of_a_person_is_found_anywhere_in_it(spark):
    far = "the end of the matter " * 10
    rows = [(1, f"Zebulon wrote. {far} mail zeb@mail.example.org now. {far} Ask for Zebulon!")]
    rows += [(100 + i, "the end of the matter is wrote mail now ask for nobody") for i in range(200)]
    got = {r.obs_id: r for r in disclosure.sanitise(obs(spark, rows)).collect()}
    assert "Zebulon" not in got[1].text_sanitised and [s.kind for s in got[1].spans] == ["email", "term", "term"]
    assert got[1].text_sanitised.count("the end of the matter") == 20 and all(got[100 + i].text_sanitised == rows[1][1] for i in range(200))


def test_disclosure_does_not_hang_on_the_size_of_the_corpus(spark):
    text = "Zebulon and Quill wrote about mail@zeb.example.org and the end"
    seen = []
    for n in (60, 300, 3000):
        rows = [(1, text)] + [(2 + i, f"Ygor and Quill wrote from ygor@mail.example.org at the end {i % 7}") for i in range(4)] + [(100 + i, f"the end of {i % 9} and about a wrote thing") for i in range(n)]
        got = {r.obs_id: r for r in disclosure.sanitise(obs(spark, rows)).collect() if r.obs_id < 100}
        seen.append([(r.text_sanitised, [(s.start, s.end, s.action) for s in r.spans]) for _, r in sorted(got.items())])
    assert seen[0] == seen[1] == seen[2]
    actions = {text[a:b]: act for a, b, act in seen[0][0][1]}
    assert actions == {"mail@zeb.example.org": "generalise", "Zebulon": "generalise"} and "Ygor" not in seen[0][1][0]


def test_revealing_terms_against_brute_force(spark):
    from math import log2

    made = random.Random(11)
    words, people = [f"w{i}" for i in range(40)], [f"p{i}@mail.example.org" for i in range(8)]
    rows = [(i, " ".join(made.choices(words, k=made.randrange(1, 6)) + made.sample(people, made.choice([0, 0, 1, 1, 2, 5])) + [f"own{i // 3}"])) for i in range(150)]
    rows += [(200, None), (201, ""), (None, rows[5][1]), rows[7], rows[7]]
    texts = [t or "" for _, t in rows]
    of = [({w for w in t.split() if "@" not in w}, {w for w in t.split() if "@" in w}) for t in texts]
    all_terms = [{w for part in t.split() for w in (part.replace("@", " ").replace(".", " ").split())} for t in texts]
    # repeated rows count once for the mentions of an entity and as often as they come for the texts of a term
    once = [of[i] for i in range(len(rows)) if rows[i] not in rows[:i]]
    n, want = len(rows), []
    for terms, entities in of:
        hits = {}
        for w in terms:
            for e in entities:
                dfe, dft = sum(e in b for _, b in once), sum(w in a for a in all_terms)
                both = sum(w in a and e in b for a, b in once)
                left = -log2((both + dfe / n) / (dft + 1))
                if left <= min(1.25, 0.4 * log2(n / dfe)):
                    hits[w] = "remove" if left <= 0.5 or hits.get(w) == "remove" else "generalise"
        want.append(hits)
    got = {}
    for r in disclosure.personal_spans(obs(spark, rows)).collect():
        got.setdefault(r.obs_id, []).append(r.spans)
    for (i, t), hits in zip(rows, want, strict=True):
        for spans in got[i]:
            assert {t[s.start:s.end]: s.action for s in spans if s.kind == "term"} == hits, (i, t)
    assert sum(map(len, want)) > 20 and len(got[7]) == 3


def test_myers_distance_and_places(spark):
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rnd = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, n))) for n in (80, 120))
        assert contamination.nearest(p, t)[0] == brute(p, t)
    item = "The quick brown fox jumps over the lazy dog, and runs away from every hunter."
    rows = [(1, "Well. THE QUICK brown fox jumps over the lazi dog and runs away from every hunter!"), (2, "clean text"), (3, None), (4, ""), (5, "x" * 100000 + " " + item)]
    inc = spark.createDataFrame([(7, item), (8, None), (9, "")], "incident_id int, text string")
    got = {r.obs_id: r for r in contamination.contaminated(obs(spark, rows), inc, block_chars=40).collect()}
    assert set(got) == {1, 5} and got[1].distance == 1 and got[5].distance == 0 and rows[4][1][got[5].start:got[5].end].startswith("The quick")
    assert contamination.contaminated(obs(spark, rows), inc.limit(0)).count() == 0


def test_overlapping_places_of_an_item_are_one():
    index = contamination.Index([("x", "ab cd " * 8)], 0.05)
    text = contamination.normalise("start " + "ab cd " * 40 + "end")
    got = sorted((a, b) for _, a, b, _ in index.find(text))
    assert 1 <= len(got) <= 5 and all(b <= c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_the_search_finds_what_edits_allow(spark):
    """Brute force: an item is in a text when some part of the text is within the budget of edits, by a plain table."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(8, 20)))) for k in range(8)]
    texts = []
    for i in range(60):
        base = " ".join(word() for _ in range(30))
        if i % 2:
            planted = list(items[i % 8][1])
            for _ in range(rnd.randrange(0, 9)):
                planted[rnd.randrange(len(planted))] = rnd.choice("abcxyz")
            base = base[:40] + " " + "".join(planted) + " " + base[40:]
        texts.append((i, base))
    texts += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]

    def least(pattern, text):
        row = [0] * (len(text) + 1)
        for c in pattern:
            old, row = row, [row[0] + 1]
            for k, t in enumerate(text, 1):
                row.append(min(old[k] + 1, row[-1] + 1, old[k - 1] + (c != t)))
        return min(row)

    want = set()
    for i, t in texts:
        for k, item in items:
            a, b = contamination.normalise(item).strip(), contamination.normalise(t or "")
            if b and least(a, b) <= int(0.05 * len(a)):
                want.add((i, k))
    df = obs(spark, texts).withColumn("item", F.lit("x")).withColumn("start", F.lit(1))
    inc = spark.createDataFrame([(k, t, "x") for k, t in items], "incident_id bigint, text string, obs_id string")
    got = contamination.contaminated(df, inc).collect()
    assert {(r.obs_id, r.incident_id) for r in got} == want and (102, 0) in want and len([r for r in got if r.obs_id == 102 and r.incident_id == 0]) == 2
    assert sorted(r.obs_id for r in contamination.uncontaminated(df, inc).where("obs_id is not null").collect()) == sorted(i for i, _ in texts if i is not None and not any(w[0] == i for w in want))


def test_nearest_observations_against_all(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    x[200:260] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [1.0, 2.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "obs_id bigint, embedding array<double>")
    got = vector_codes.nearest_observations(df, F.col("obs_id") % 50 == 0, cell_rows=60, probe_share=1.0).collect()
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q])**2).sum(axis=1))
        d[q] = np.inf
        mine = [(r.obs_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query == q]
        assert [i for i, _ in mine] == np.lexsort((np.arange(400), d))[:10].tolist()
        assert np.allclose([s for _, s in mine], np.sort(d)[:10], rtol=0, atol=1e-12)
    few = vector_codes.nearest_observations(df.limit(4), F.lit(True)).collect()
    assert len(few) == 12 and vector_codes.nearest_observations(df.limit(0), F.lit(True)).count() == 0


def test_language(spark):
    en, de = "the old house on the hill with many windows", "das alte haus auf dem berg mit vielen fenstern und"
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(80)] + [(900, None, "en"), (901, "!!! 123", None), (902, "", None), (903, "hill " * 50000, None)]
    df = spark.createDataFrame(rows, "obs_id bigint, text string, lang string")
    got = {r.obs_id: r for r in identify(df, train(df)).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == lang for i, _, lang in rows[:80]) and not any(got[i].rejected for i in range(80))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "en"
    assert identify(df.limit(0), train(df.limit(0))).count() == 0


def test_texts_without_letters_have_no_language(spark):
    en, de = "the old house on the hill with many windows", "das alte haus auf dem berg mit vielen fenstern und"
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(80)]
    odd = [(901, "\u2014 \u2014\u2013"), (902, "\U0001F600 \U0001F600"), (903, "\u0661\u0662\u0663"), (904, "\u201eooo\u201c".replace("o", "\u201d")), (905, "123 !"), (906, "\u0301\u0300")]
    df = spark.createDataFrame([*rows, *[(i, t, None) for i, t in odd], *[(i, t, None) for i, t in odd]], "obs_id bigint, text string, lang string")
    df = df.withColumn("letters", F.lit("x")).withColumn("rejected", F.lit(5)).withColumn("score", F.lit("y"))
    got = [r for r in identify(df, train(df)).collect() if r.obs_id > 900]
    assert len(got) == 2 * len(odd) and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in got)
    kept = identify(df, train(df), keep=("obs_id", "text", "score"))
    assert {r.obs_id for r in kept.where("not rejected").collect()} == {i for i, _, _ in rows}


def test_noise_is_rejected_whatever_its_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(1)
    noise = [(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(5000))) for i in range(3)]
    noise += [(10 + i, "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))) for i in range(3)]
    model = train(docs, "doc_id")
    assert all(r.rejected for r in identify(spark.createDataFrame(noise, "obs_id bigint, text string"), model).collect())
    got = identify(docs, model, "doc_id").join(docs.where("lang is not null and n_chars > 200").select("doc_id", "lang"), "doc_id").agg(
        F.avg(F.col("rejected").cast("int")).alias("gone"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert got.gone < 0.02 and got.right > 0.98


def test_toxicity(spark):
    rnd, rows, marks = random.Random(4), [], []
    words = ["river", "house", "market", "window", "street", "garden", "bridge", "morning"]
    bad = ["idiot", "moron", "scum", "blorkish", "blorkest"]
    for i in range(600):
        toxic = i % 6 == 0
        w = [rnd.choice(words) for _ in range(30)] + ([rnd.choice(bad) for _ in range(3)] if toxic else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "river " * 50000)]
    ann = spark.createDataFrame(marks, "obs_id bigint, toxic int")
    got = {r.obs_id: r for r in toxicity.score(obs(spark, rows), toxicity.train(obs(spark, rows), ann, bits=18)).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert len(got) == len(rows) and sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (900, 901, 902))
    none = toxicity.score(obs(spark, []), toxicity.train(obs(spark, []), ann.limit(0), bits=18))
    assert none.count() == 0


def test_toxic_texts_are_found_in_every_language(spark):
    """Held-out recall and false alarms by language; some languages have about fifty annotated toxic texts."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "obs_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "obs_id")
    got = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out")
    per = got.join(labels, "obs_id").join(docs.select("obs_id", F.col("lang").alias("l")), "obs_id").groupBy("l").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("alarms")).collect()
    assert len(per) == 4 and all(r.found >= 0.85 and r.alarms <= 0.05 for r in per), per


def test_annotations_that_clash_and_repeat(spark):
    rows = [(i, ("you idiot moron " if i % 3 == 0 else "a calm word ") + f"w{i % 7}") for i in range(120)] * 2
    marks = [(i, int(i % 3 == 0)) for i in range(120)] + [(i, 0) for i in range(0, 120, 3)] + [(None, 1), (5, None)]
    df = obs(spark, [*rows, (None, "you idiot"), (900, None), (901, "")]).withColumn("votes", F.lit(1)).withColumn("toxic", F.lit("x"))
    got = toxicity.score(df, toxicity.train(df, spark.createDataFrame(marks, "obs_id bigint, toxic int"))).collect()
    assert len(got) == 243 and all(r.predicted == int(r.obs_id % 3 == 0) for r in got if r.obs_id is not None and r.obs_id < 120)
    assert len({r.score for r in got if r.obs_id == 3}) == 1


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    rows = [(1, "Intro.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, "nothing here"),
            (6, mit + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
            (7, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
            (8, "Licensed under CC BY-NC 4.0.\nAll rights reserved.")]
    got = {r.obs_id: (r.licences, r.n_unmatched) for r in licence_scan.scan_licences(obs(spark, rows)).collect()}
    assert got == {1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("MIT", 0), 7: ("GPL-3-or-later", 0), 8: ("CC-BY-NC-4.0", 1)}
    assert licence_scan.scan_licences(obs(spark, [])).count() == 0


def test_wrapped_notices_of_licences(spark):
    import textwrap

    wrap = lambda s, mark="": "\n".join(mark + x for x in textwrap.wrap(s, 70))
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
    apache = [wrap("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "# "), "#", "#     http://www.apache.org/licenses/LICENSE-2.0", "#", "# Unless required by applicable law"]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
           "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    rows = [(1, "MIT License\n\n" + "\n\n".join(map(wrap, mit))), (2, "\n".join(apache)), (3, wrap(gpl, " * ")), (4, "\n".join(map(wrap, bsd))), (5, "A title\nReleased under the MIT License\nand more"),
            (6, "\n".join(map(wrap, bsd[:3])).replace("\n", "\r\n"))]
    got = {r.obs_id: (r.licences, r.n_unmatched) for r in licence_scan.scan_licences(obs(spark, rows)).collect()}
    assert got == {1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("GPL-3-or-later", 0), 4: ("BSD-3-Clause", 0), 5: ("MIT", 0), 6: ("BSD-2-Clause", 0)}


def test_more_licences_and_long_addresses(spark):
    import duckdb

    host = "a." * 400 + "org"
    rows = [(1, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
            (2, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
            (3, "// SPDX-License-Identifier: Apache-2.0\n# SPDX-License-Identifier: GPL-2.0+\n/* SPDX-License-Identifier: BSD-3-Clause */"),
            (4, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), (5, "Creative Commons Attribution 4.0 International"),
            (6, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
            (7, "Licensed under the GNU Affero General Public License v3.0"), (8, "This is free and unencumbered software released into the public domain."),
            (9, f"See http://{host}/all\nAll rights reserved."), (10, f"See http://{host}.all rights reserved"), (11, "Distributed under the Boost Software License, Version 1.0."),
            (12, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"), (12, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
            (None, "SPDX-License-Identifier: CC-BY-SA-4.0")]
    found = licence_scan.scan_licences(obs(spark, rows)).collect()
    got = {r.obs_id: (r.licences, r.n_unmatched) for r in found}
    assert got == {1: ("LGPL-2.1-or-later", 0), 2: ("MPL-2.0", 0), 3: ("Apache-2.0,GPL-2.0-or-later,BSD-3-Clause", 0), 4: ("CC-BY-NC-4.0", 0), 5: ("CC-BY-4.0", 0), 6: ("ISC", 0), 7: ("AGPL-3.0-only", 0),
                   8: ("Unlicense", 0), 9: ("", 1), 10: ("", 0), 11: ("BSL-1.0", 0), 12: ("EPL-2.0", 0), None: ("CC-BY-SA-4.0", 0)} and len(found) == len(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    own = con.sql(f"SELECT doc_id, licences, n_unmatched FROM ({licence_scan.sql()})").fetchall()
    assert sorted(map(str, own)) == sorted(str((r.obs_id, r.licences, r.n_unmatched)) for r in found)
    import re
    assert all(re.search(licence_scan.WORDS, s) for s in licence_scan.KNOWN)


def test_source_lists(spark):
    cap = spark.createDataFrame([(1, "https://u:p@WWW.Bad.example.com:80/a/b?q=1", "2024-03-01"), (2, "https://www.bad.example.com/a/b", "2024-06-01"), (3, "http://other.example.com/", "2024-03-01"),
                                 (4, None, "2024-03-01"), (5, "no address", "2024-03-01"), (6, "https://www.bad.example.com/ok/x", "2024-03-01"), (6, "https://www.bad.example.com/ok/x", "2024-03-01"),
                                 (7, "https://www.bad.example.com/", None)], "capture_id int, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at"))
    ent = spark.createDataFrame([("l", "host", "www.bad.example.com", "block", "2024-02-01"), ("l", "host", "www.bad.example.com", "remove", "2024-05-01"),
                                 ("l", "path", "www.bad.example.com/ok", "allow", "2024-01-01"), ("m", "domain", "example.com", "block", "2024-06-01"), ("m", None, "x", "block", "2024-01-01")],
                                "list_name string, scope string, value string, action string, listed_on string").withColumn("listed_on", F.to_date("listed_on"))
    rows = source_lists.filter_captures(cap, ent).collect()
    got = {r.capture_id: (r.decision, r.n_entries) for r in rows}
    assert len(rows) == 8
    assert got == {1: ("block", 1), 2: ("block", 1), 3: ("none", 0), 4: ("none", 0), 5: ("none", 0), 6: ("allow", 2), 7: ("none", 0)}
    assert source_lists.filter_captures(cap.limit(0), ent).count() == 0 and source_lists.filter_captures(cap, ent.limit(0)).where("decision <> 'none'").count() == 0


def test_entries_are_read_like_addresses(spark):
    day = __import__("datetime").date(2024, 1, 1)
    rows = [("l", "host", "EX.com", "block", day), ("l", "path", "a.org//x/y/", "block", day), ("l", "domain", ".Deep.net.", "block", day), ("l", "host", None, "block", day)]
    entries = spark.createDataFrame(rows, "list_name string, scope string, value string, action string, listed_on date").withColumn("url", F.lit("x"))
    caps = spark.createDataFrame([(1, "http://ex.com/"), (2, "https://A.org/x/y/z"), (3, "http://very.deep.net:80/"), (4, "http://a.org/x"), (5, None)], "capture_id int, url string").withColumn("fetched_at", F.lit(day))
    got = {r.capture_id: r.decision for r in source_lists.filter_captures(caps, entries).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "none", 5: "none"}


def test_list_entries_of_any_depth_match(spark):
    host = "a.b.c.d.e.f.g.example.com"
    cap = spark.createDataFrame([(1, f"https://{host}/1/2/3/4/5/6/7/x"), (2, f"https://{host}/1/2/3/4/5/6/8"), (3, "https://z.c.d.e.f.g.example.com/"), (4, "https://g.example.com/1/2")],
                                "capture_id int, url string").withColumn("fetched_at", F.to_date(F.lit("2024-03-01")))
    ent = spark.createDataFrame([("l", "path", f"{host}/1/2/3/4/5/6/7", "allow"), ("l", "domain", "b.c.d.e.f.g.example.com", "block"), ("l", "domain", "c.d.e.f.g.example.com", "block")],
                                "list_name string, scope string, value string, action string").withColumn("listed_on", F.to_date(F.lit("2024-01-01")))
    got = {r.capture_id: (r.decision, r.n_entries) for r in source_lists.filter_captures(cap, ent).collect()}
    assert got == {1: ("allow", 3), 2: ("block", 2), 3: ("block", 1), 4: ("none", 0)}


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_a_query(n):
    from obsweave.llm.queries import Q

    assert sum(k.startswith(f"op{n}_") for k in Q) == 1


def test_pipeline_stages(spark):
    """Each stage on its own input, against a plain rule where one decides: what stays, and that it stays as it was."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(C.STAGES)
    base = docs.limit(40).collect()
    long = " ".join(f"word{i}" for i in range(60))
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "\u2014 \u2014", "en", "s", 3), (None, "x y", "en", "s", 3), (9004, long, "en", "s", 1), (9004, long, "en", "s", 1),
           (9005, long.replace("word7 ", "w "), "en", "s", 1), (9006, "q r s\n" * 3, "en", "s", 1)]
    mine = spark.createDataFrame([tuple(r) for r in base] + odd, docs.schema)

    got = stage["language_id"](spark, mine, sf).collect()
    assert not {9001, 9002, 9003} & {r.doc_id for r in got} and {tuple(r) for r in got} <= {tuple(r) for r in base} | set(odd)
    assert len({r.doc_id for r in got} & {r.doc_id for r in base}) >= 36

    got = stage["ngram_jaccard"](spark, mine, sf).collect()
    sets = {}
    for r in [*base, *odd]:
        if r[0] is not None:
            sets.setdefault(r[0], shingles(r[1], 5))
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i in sets if label[i] == i)
    assert sum(r.doc_id is None for r in got) == 1

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    withit = spark.createDataFrame([(1, f"before {item} after", "en", "s", 1), (2, item.upper(), "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "clean text", "en", "s", 1)], docs.schema)
    assert sorted((r.doc_id or 0) for r in stage["decontamination"](spark, withit, sf).collect()) == [0, 3, 4]

    assert {r.doc_id for r in stage["line_dedup"](spark, mine, sf).collect()} >= {9001, 9002, 9004, 9005, 9006, None}
    packed = stage["packing"](spark, mine, sf)
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in [*base, *odd]})
    for name, step in C.STAGES:
        empty = step(spark, docs.limit(0), sf)
        assert empty.count() == 0 and (name == "packing" or empty.columns == list(C.COLUMNS))


def test_pipeline_runs_from_end_to_end(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = C.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert 0 < len(whole) < docs.count() and all(r.n == r["all"] for r in whole)
