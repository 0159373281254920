"""The ten operators against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkbars.llm import licences, pii, suffixes
from sparkbars.llm.decontam import contamination
from sparkbars.llm.packing import best_fit
from sparkbars.llm.queries import queries

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}


def rows(spark, name):
    return queries()[name](spark, ROOT).collect()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]


def test_licences_are_those_of_declared_lines(spark, texts):
    want = {(d, n) for d, t in texts.items() for n, line in licences.TEMPLATES.items() if any(
        words(x.strip(" .")) == words(line.strip(" .")) for x in t.split("\n"))}
    assert {(r.doc_id, r.licence) for r in rows(spark, "op1_licence_scan") if r.dice == 1.0} == want


def test_a_changed_licence_is_still_found_and_prose_is_not(spark):
    changed = licences.TEMPLATES["MIT"].replace("person", "person or group").replace("rights", "right")
    docs = spark.createDataFrame([(1, f"Intro here.\n\n{changed}\n\nMore."), (2, "the software is nice and the authors are kind")], "doc_id long, text string")
    found = licences.licences(docs).collect()
    assert [(r.doc_id, r.licence) for r in found] == [(1, "MIT")] and 0.9 < found[0].dice < 1


def test_licences_in_any_layout_are_found_inside_longer_texts(spark):
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(rng.choice("the of software licence river stone and to in any permission use rights copies".split(), n))
    mit, apache = (licences.TEMPLATES[n].replace("\n", " ") for n in ("MIT", "Apache-2.0"))
    three = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    header = apache.replace("License. You", "License.\n\nYou").replace("2.0 Unless", "2.0\n\nUnless").replace("You may", "You may\n\n")
    wrap = lambda text: re.sub(r"(.{60,70}) ", r"\1\r\n", text)
    declared = "This software is good. Released under the MIT License. And so on"
    docs = [(1, f"{prose(300)}\n\n{three}\n\n{prose(300)}"), (2, f"{prose(40)}\n\n{header}\n\n{prose(400)}"), (3, f"{prose(90)}\r\n\r\n{wrap(mit)}\r\n\r\n{prose(90)}"),
            (4, f"{prose(50)} {declared} {prose(50)}"), (5, prose(3000)), (6, f"{prose(90)} {mit} {prose(9)} {mit} {prose(90)}")]
    found = [(r.doc_id, r.licence, r.dice, r.n_passages) for r in licences.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted((d, n, k) for d, n, _, k in found) == [(1, "MIT", 1), (2, "Apache-2.0", 1), (3, "MIT", 1), (4, "MIT (declared)", 1), (6, "MIT", 2)]
    assert all(x > 0.98 for *_, x, _ in found)
    spans = {r.doc_id: docs[r.doc_id - 1][1][r.start:r.end] for r in licences.licence_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert spans[4] == "Released under the MIT License" and spans[1] == three.strip(".")


def brute_strings(texts, width):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(r[k:k + width] for r in raw.values() for k in range(len(r) - width + 1))
    out = {}
    for d, r in raw.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - width + 1):
            if seen[r[k:k + width]] > 1:
                gone[k:k + width] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[d] = len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def test_repeated_strings(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op2_suffix_array_dedup")}
    assert got == brute_strings(texts, suffixes.WIDTH)


def test_hot_keys_give_the_same_strings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh "), 450))
    texts = {k: "".join(rng.choice(list("ijklmn "), 500)) + passage + "".join(rng.choice(list("opqrst "), 500)) for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limit in (suffixes.HOT, 3):
        monkeypatch.setattr(suffixes, "HOT", limit)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_strings(docs).drop("kept").collect()}
        assert got == brute_strings(texts, suffixes.WIDTH) and all(v[1] >= 450 for v in got.values())


def _shared(text, i, j, reach):
    n = 0
    while n < reach and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
        n += 1
    return n


def test_suffix_order_and_queues_on_disk(monkeypatch):
    """Order and common prefixes against sorting, over several levels of names, ranges of few symbols and queues that go to disk."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        monkeypatch.setattr(suffixes, "RANGE", int(rng.integers(1, 30)))
        letters = int(rng.integers(1, 6))
        body = rng.integers(trial % 2, letters + 1, int(rng.integers(1, 120)))
        if trial % 5 == 0:
            body = np.tile(body[:max(1, len(body) // 6)], 8)
        if trial % 7 == 0:
            body = np.repeat(body, rng.integers(1, 9, len(body)))
        text = [*body.tolist(), int(rng.integers(1, letters + 1)), 0]
        order, common = suffixes.suffix_order(np.array(text, np.uint16), budget=int(rng.integers(3, 50)))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        assert common.tolist() == [0, *(_shared(text, i, j, suffixes.WIDTH) for i, j in zip(want, want[1:], strict=False))]


def test_suffix_order_within_a_reach():
    rng = np.random.default_rng(6)
    for _ in range(200):
        reach = int(rng.integers(1, 8))
        text = [*np.tile(rng.integers(0, 4, int(rng.integers(1, 30))), int(rng.integers(1, 6))).tolist(), 1, 0]
        order, common = suffixes.suffix_order(np.array(text, np.uint16), reach=reach, budget=10)
        heads = [text[i:i + reach] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
        assert common.tolist() == [0, *(_shared(text, i, j, reach) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))]


def test_queues_spill_at_the_registered_parameters(monkeypatch):
    """A shard of the registered size holds more tuples than the memory budget: its queues go to disk."""
    files, make = [], suffixes.tempfile.TemporaryFile
    monkeypatch.setattr(suffixes.tempfile, "TemporaryFile", lambda **kw: files.append(kw) or make(**kw))
    text = np.append(np.random.default_rng(7).integers(1, 200, suffixes.SHARD_BYTES), [1, 0]).astype(np.uint16)
    order, _ = suffixes.suffix_order(text)
    raw, step = text.astype(">u2").tobytes(), 997
    heads = [raw[2 * i:2 * i + 800] for i in order[::step].tolist()]
    assert files and heads == sorted(heads)


def test_shared_passages_survive_insertions(spark):
    from sparkbars.llm.chunks import shared_passages

    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = prose(60)
    docs = [(1, f"{prose(50)} {passage} {prose(30)}"), (2, f"{prose(71)}, {passage} {prose(9)}"), (3, prose(200)), (4, "short")]
    found = {r.doc_id: r for r in shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(found) == {1, 2} and found[1].n_removed == 0 and found[2].n_removed >= 200 and found[2].n_spans == 1
    assert bytes(found[1].kept) == docs[0][1].encode()
    assert len(found[2].kept) == found[2].n_bytes - found[2].n_removed and docs[1][1].encode().startswith(bytes(found[2].kept)[:400])


def test_passages_of_fifty_words_are_found_almost_always(spark):
    from sparkbars.llm.chunks import shared_passages

    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))
    docs = []
    for k in range(1000):
        passage = prose(50)
        docs += [(2 * k, f"{prose(5)} {passage} {prose(7)}"), (2 * k + 1, f"{prose(9)} {passage} {prose(3)}")]
    found = {r.doc_id: r.n_removed for r in shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(found.get(2 * k + 1, 0) >= 100 for k in range(1000)) >= 999


def test_exact_copies_share_all_chunks(spark, texts):
    found = {r.doc_id: r for r in rows(spark, "op3_substring_dedup")}
    first = {}
    for d, t in sorted(texts.items()):
        if len(t.encode()) >= 100 and first.setdefault(t, d) != d:
            assert found[d].n_removed == found[d].n_bytes, d


def auc(good, bad):
    order = np.argsort(np.argsort(np.concatenate([good, bad]))) + 1
    return (order[:len(good)].sum() - len(good) * (len(good) + 1) / 2) / len(good) / len(bad)


def test_quality_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    found = queries()["op4_quality_classifier"](spark, root).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert auc(np.array([s for s, y in held if y == 1]), np.array([s for s, y in held if y == 0])) > 0.95


def test_language_on_held_out_rows(spark):
    root = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    found = queries()["op5_language_id"](spark, root).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out]
    assert sum(held) / len(held) > 0.98


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 8 <= len(digits) <= 15 or (
                    kind == "card" and 16 <= len(digits) <= 19 and total % 10 == 0):
                out.append((kind, *m.span()))
    return out


def test_base_patterns(spark, texts):
    for r in rows(spark, "op6_personal_data"):
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]


@pytest.mark.parametrize("text", ["a@b.c.d@e.ff x@y@z.com @q.com", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 01.002.3.4", "4111 1111 1111 1111-4111111111111111",
                                  "+1 (017) 555-7713-+49 12+", "é@x.y ä.b@c-d.e", "9" * 4000 + ".1.2.3", "+1((((((", "@" * 50])
def test_odd_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_spans(text)


def test_field_finds_names_and_secrets_and_redacts(spark):
    text = "Then Dr. Anna Keller called.\nThe token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" is on.12@mail.example.com at 10.0.0.1. The old river."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "The old river was there. Many came.", "z")], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "Then Dr. [PERSON] called.\nThe token = \"[SECRET]\" is [EMAIL] at [IP]. The old river." and out[1].spans == "x"
    assert out[2].text is None and out[3].text == docs.collect()[2].text


def test_viterbi_over_open_stretches_is_the_best_path():
    field = pii.Field(pii.labelled_rows(), steps=20)
    rng = np.random.default_rng(3)
    for sentence in pii.labelled_rows()[::37]:
        raw = np.frombuffer(re.sub(r"\{\w+ ([^}]*)\}", r"\1", sentence).encode(), np.uint8)
        tokens = pii.Tokens(raw, np.array([0, len(raw)]), field.vocabulary)
        scores = field.states[tokens.features].sum(axis=1)
        value = lambda path: sum(scores[t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))  # noqa: B023,B905,E731
        best = field.labels(tokens)
        for _ in range(200):
            other = best.copy()
            other[rng.integers(0, len(best), 2)] = rng.integers(0, 5, 2)
            assert value(best) >= value(other) - 1e-9


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    from sparkbars.llm.packing import pack

    found = pack(spark.read.parquet(f"{ROOT}/documents.parquet"), keep_ids=True).collect()
    own = {}
    for r in found:
        own.setdefault(r.doc_id, []).append(r)
    assert set(own) == set(texts)
    lengths = []
    for d, pieces in own.items():
        ids = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == ids and [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        assert all(r.length == 1024 for r in pieces[1:]) and 1 <= pieces[0].length <= 1024
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)
        lengths += [r.length for r in pieces]
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == plain_best_fit(lengths, 1024)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_on_counts_equals_one_by_one():
    rng = np.random.default_rng(7)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
        plan = best_fit(Counter(lengths), capacity)
        assert len({int(first + k) for length, rank, first, offset, each in plan.tolist() for k in range(1)}) <= len(lengths)
        used = set()
        for length, n in Counter(lengths).items():
            steps = plan[plan[:, 0] == length]
            for rank in range(n):
                _, r0, first, offset, each = steps[np.searchsorted(steps[:, 1], rank, "right") - 1].tolist()
                start = offset + (rank - r0) % each * length
                cells = {(first + (rank - r0) // each, c) for c in range(start, start + length)}
                assert start + length <= capacity and not cells & used
                used |= cells
        assert len({b for b, _ in used}) == plain_best_fit(lengths, capacity)


def test_near_duplicates(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = words(t or "")
        sets[d] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op8_minhash_near_dedup")}
    assert got == {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_links_that_no_head_shows(spark):
    """A chain in which each text is near the next only, so that heads of bands miss links."""
    base = [f"w{k}" for k in range(120)]
    docs = [(n, " ".join(base[7 * n:7 * n + 60])) for n in range(8)]
    from sparkbars.llm.near_dup import near_duplicates

    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_nearest_neighbours(spark):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()}
    got = {}
    for r in rows(spark, "op9_nearest_neighbours"):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {v for v in vectors if v % 20 == 0}
    for q, found in got.items():
        score = {v: float(np.cumsum(vectors[q] * x)[-1]) for v, x in vectors.items() if v != q}
        want = sorted(score, key=lambda v: (-score[v], v))[:20]
        assert [(k + 1, v, score[v]) for k, v in enumerate(want)] == sorted(found)


def test_neighbours_of_odd_vectors(spark):
    from sparkbars.llm.neighbours import nearest_of_every

    nan, big = float("nan"), 1e200
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, []), (7, [1.0, None]), (None, [1.0, 1.0]),
            (8, [-1.0, 0.5]), (9, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (40, [big, 0.0]), (60, [1e-200, 0.0])]
    frame = spark.createDataFrame([(*d, 1.0) for d in data], "vec_id long, embedding array<double>, score double")
    found = {}
    for r in nearest_of_every(frame, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found[0] == [(40, big), (1, 1.0), (2, 1.0)] and found[20] == [(9, 14.0)] and found[40][0] == (0, big) and found[60][0] == (40, 1.0)


def test_contamination(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if plain(x) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op10_benchmark_decontamination")}
    assert want and want <= got and len(got - want) <= 1


def test_reparameterised_items(spark):
    item = "Tom has 9 apples and gives 2 kg to Bob while 8 birds sing loudly today in the park."
    docs = [(1, "Words before. Tom has 5 apples and gives 3 kg to Ann while 4 birds sing loudly today in the park. End."), (2, item.upper()),
            (3, "Tom has no apples but the birds sing loudly every day."), (4, item.replace("sing", "do not sing at all"))]
    found = {r.doc_id: r.reparameterised for r in contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "x"), (9, None)], "item_id long, text string")).collect()}
    assert found[1] is True and 3 not in found


def test_copies_in_other_case_or_without_punctuation_or_of_numbers_are_contaminated(spark):
    prose = "Tom has 9 apples and gives 2 kg to Bob while 8 birds sing loudly today in the park."
    names = "Über Köln flog Anna. Then Bob, Carl and Dora met Emil, Fritz and Gerd near Halle before Ida left Weißensee for Kiel."
    numbers = "1 22 333 44 5 66 777 88 9 10 11 12 13"
    items = [(1, prose), (2, names), (3, numbers), (4, "12 + 34 = 46"), (5, "Never 7.")]
    docs = [(10 * i + k, f"Before it, {copy} after it") for i, x in items for k, copy in enumerate(
        (x, x.upper(), x.lower(), re.sub(r"[^\w\s]", "", x), re.sub(r"[^\w\s]", "", x).upper(), x.replace(" ", " \u201c").replace(".", "\u2026")))]
    docs.append((99, "1 22 333 Tom has no apples, and Anna met Bob near Kiel, 12 and 34."))
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 10) for d, _ in docs[:-1]}
    assert all(r.share == 1 for r in found if r.item_id <= 3 and r.doc_id % 10 < 5)


def test_long_passages_and_copies_with_one_changed_value_are_contaminated(spark):
    rng = np.random.default_rng(5)
    w = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(59)]
    problem = [*w[:3], "41", *w[4:24], "17", *w[25:40], "17", *w[41:]]
    items = [(1, " ".join(w)), (2, " ".join(problem)), (3, " ".join(w[:12])), (4, "A b, c d."), (5, " ".join(w[20:30][::-1]))]
    other = " ".join("".join(rng.choice(list("klmnop"), 6)) for _ in range(20))
    changed = [*problem[:3], "52", *problem[4:24], "18", *problem[25:40], "19", *problem[41:]]
    docs = [(1, " ".join([other, *w[42:55], other])), (2, " ".join([other, *w[42:54], other])), (3, " ".join([other, *changed])),
            (4, f"{other} {' '.join(w[:12])} {other}"), (5, f"{other} a B c, D {other}"), (6, " ".join([other, *w[20:50], other]))]
    found = {(r.doc_id, r.item_id): r for r in contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (1, 1) in found and (6, 1) in found and not [d for d, _ in found if d == 2] and (4, 3) in found and (5, 4) in found
    assert found[3, 2].share == 1 and found[3, 2].reparameterised and 23 <= found[6, 1].n_matched < 26
    assert not [i for _, i in found if i == 5]


@pytest.mark.parametrize("dim", [1500, 4096])
def test_neighbours_in_many_dimensions(spark, dim):
    from sparkbars.llm.neighbours import nearest_of_every

    vectors = np.random.default_rng(dim).choice([-1.0, 1.0], size=(84, dim))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest_of_every(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 84, 20):
        score = vectors @ vectors[q]
        assert found[q] == [(i, score[i]) for i in np.lexsort((np.arange(84), -score)) if i != q][:20]


def test_links_between_texts_with_a_common_frame(spark, monkeypatch):
    from sparkbars.llm import near_dup

    rng = np.random.default_rng(5)
    docs = []
    for k in range(240):
        frame = [f"frame{k}" for k in range([180, 240, 255][k % 3])]
        own = [f"w{x}" for x in rng.integers(0, 10**6, 300 - len(frame))]
        docs.append((k, " ".join(frame + own)))
        if k % 6 == 0:
            own[len(own) // 2] = "changed"
            docs.append((1000 + k, " ".join(frame + own)))
    sets = {d: {tuple(words(t)[k:k + 5]) for k in range(len(words(t)) - 4)} for d, t in docs}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for pairwise in (0, near_dup.PAIRWISE, 10**9):
        monkeypatch.setattr(near_dup, "PAIRWISE", pairwise)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()}
        assert got == root
    assert len(set(root.values())) == 240 and len(root) == 280
