import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brute import WORD

from textyard.llm import collocations, conversations, host_rules, words as wd

CLASHING = "doc_id bigint, text string, source string, lang string, host string, kept boolean, route int, h bigint, phrase string, _key string, row int"


def awkward_docs(spark):
    base = " ".join(f"word{i}" for i in range(40))
    texts = [
        base, base, "", None, "few words here", f"{base}\n{base}\nthe end", " \n\t\n \n", "#$ a|b <c> 50% & *\n#$ a|b <c> 50% & *\n" + base,
        "été naïve 日本語 " * 12, " ".join(["again and again it goes round and round"] * 9), "x" * 5000, "a.b,c;d:e!f?g\x0bh\x0ci\rj " * 30,
    ]
    ids = [1, 1, 2, 3, None, 5, 6, 7, 8, 9, 10, 11]
    rows = [(i, t, [None, "a", "b"][n % 3], ["en", None, "und"][n % 3], "x", True, n, n, "p", "k", n) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, CLASHING)


# words ---------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [3, 7, 64, 1 << 20])
def test_words_do_not_depend_on_the_pieces(piece):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abC dE.\n\t,é") for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(60)]
    blobs = [t.encode() for t in texts]
    got = wd.gathered(wd.scan(blobs, lower=True, piece=piece), wd.Words._fields)
    seen = {}
    want = [(o, m.start(), m.group().lower()) for o, b in enumerate(blobs) for m in re.finditer(rb"[^ \t-\r]+", b)]
    assert [(o, s, blobs[o][s : s + n].lower()) for o, s, n in zip(*(got[i].tolist() for i in (1, 2, 3)))] == want
    for h, (_, _, word) in zip(got[0].tolist(), want):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    runs = wd.gathered(wd.scan(blobs, wd.byte_set(b" \t\n\r\x0b\x0c.,"), wd.byte_set(b".,\n"), piece=piece), ("run", "owner", "start"))
    parts = [(o, b[: m.start()].count(b".") + b[: m.start()].count(b",") + b[: m.start()].count(b"\n")) for o, b in enumerate(blobs) for m in re.finditer(rb"[^ \t-\r.,]+", b)]
    assert len(parts) == len(runs[0])
    numbers = {}
    for part, run in zip(parts, runs[0].tolist()):
        assert numbers.setdefault(part, run) == run
    assert len(set(numbers.values())) == len(numbers)


# op11 ----------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "c", "#", "é", "\n", "日 ", "|"]) for _ in range(rng.choice((0, 3, 30, 200)))) for _ in range(200)]
    got = host_rules.counts([t.encode() for t in texts])
    assert [tuple(int(c[i]) for c in got) for i in range(len(texts))] == [brute_counts(t) for t in texts]
    for t in texts:
        assert host_rules.repeated_lines(t.encode(), whole=5) == brute_counts(t)[3]


def test_counts_of_a_long_text():
    text = "one two three four five six seven eight nine\n" * 60_000 + "x" * 3_000_000 + "é" * 20
    got = [int(c[0]) for c in host_rules.counts([text.encode()])]
    assert got == [540_001, 60_000 * 36 + 3_000_020, 0, 59_999, 540_000]


def test_hosts_with_mostly_failing_documents_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good if i % 50 else bad, "fine") for i in range(300)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(300)]
    rows += [(2000, bad, "once"), (2001, good, None), (2002, good, "one")]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    by_host = got.groupby(got.host.fillna("null"))
    assert not got[got.host == "spam"].kept.any() and got[(got.host == "fine") & ~got.base_failed].kept.all()
    rate = by_host.host_rate.first()
    # one failure of one moves a host up, but not to a rate of 1
    assert 0.02 <= rate["fine"] < rate["one"] < rate["once"] < 1 and 0.89 < rate["spam"] < 0.901
    assert by_host.size()["null"] == 1 and len(got) == len(rows)
    n, f = by_host.size().to_numpy(float), by_host.base_failed.sum().to_numpy(float)
    m = f.sum() / n.sum()
    free, room = len(n) - 1, n.sum() - (n * n).sum() / n.sum() - (len(n) - 1)
    r = (((n * (f / n - m) ** 2).sum()) / (m * (1 - m)) - free) / room
    strength = 1 / min(r, 0.5) - 1
    assert np.allclose(by_host.host_rate.first().to_numpy(), (f + strength * m) / (n + strength), atol=1e-6)


def test_host_rules_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = host_rules.judge(docs)
    texts = [r.text for r in docs.collect()]
    have = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert have == Counter(brute_counts(t) for t in texts)
    kept = host_rules.keep(docs, max_rate=0.9)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in host_rules.judge(docs, max_rate=0.9).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want and want[1] == 2
    assert host_rules.judge(docs.limit(0)).count() == 0 and host_rules.keep(docs.limit(0)).count() == 0
    same = docs.limit(1)
    assert [r.host_rate for r in host_rules.judge(same).collect()] == [0.0]


# op12 ----------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Figures of one damaged conversation; all cheapest edits by shortest paths over (row, state, letters)."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "", ())}  # state -> cost, letters, lines; the least letters of the least cost

    def better(table, state, item):
        if state not in table or (item[0], item[1]) < (table[state][0], table[state][1]):
            table[state] = item

    def inserted(table):
        for _ in range(4):
            for (state, initial), to in step.items():
                if state in table and initial != "s":
                    cost, letters, lines = table[state]
                    better(table, to, (cost + 5, letters + "I", (*lines, {"u": "user:", "a": "assistant:"}[initial])))
        return table

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, letters, lines) in best.items():
            better(after, state, (cost + 2, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if (state, role[:1]) in step:
                better(after, step[state, role[:1]], (cost + extra, letters + "K", (*lines, f"{role}:{text}")))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if (state, initial) in step:
                    better(after, step[state, initial], (cost + extra + 1, letters + "R", (*lines, f"{name}:{text}")))
        best = inserted(after)
    cost, letters, lines = min(best[s] for s in (0, 3) if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_block_tables_find_the_least_cost_and_letters():
    rng = random.Random(3)
    for _ in range(3000):
        signs = bytes(rng.randrange(9) for _ in range(rng.randrange(14)))
        cost, edits = conversations.tables().repair(signs)
        letters = "".join(e for _, e, _ in edits)
        rows = [(1, i, "suao"[s % 4] if s < 8 else "o", f"t{i}" + ("." if s < 4 else "")) if s < 8 else (1, i, "o", "") for i, s in enumerate(signs)]
        want = brute_repair(rows)
        assert (cost, letters) == want[5:7], (list(signs), want)
    assert len(conversations.tables().vectors) < 200


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice((1, 2, 3, 5, 8, 30))):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None])
            text = rng.choice([f"text {turn}.", f"text {turn}!", f"cut {turn}", "same.", "same.", "", " \n", None, "é?\n "])
            rows += [(conv, rng.choice([turn, turn, turn, None, 2 * turn]), role, text)] * rng.choice((1, 1, 1, 3))
    return rows


def test_repair_equals_brute_force(spark):
    rows = talk(1, 150)
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, place int")
    got = conversations.repair(given).collect()
    groups = defaultdict(list)
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted({(r[0] is None, r[0] or 0) for r in rows})
    for r in got:
        assert tuple(r)[1:] == brute_repair(groups[r[0]]), r[0]
    lines = conversations.repaired_turns(given).collect()
    by_conv = defaultdict(dict)
    for r in lines:
        by_conv[r.conv][r.turn] = r.line
    for r in got:
        mine = by_conv[" " if r[0] is None else str(r[0])]
        assert hashlib.sha256("\n".join(mine[i] for i in range(len(mine))).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_empty_and_dropped_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    dropped = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = conversations.repair(spark.createDataFrame([(*dropped, "user", "gone.")], schema)).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_one_conversation_with_most_rows(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"line {i}.") for i in range(20_000)] + [(7, 1, "user", "line 1.")] * 5_000
    got = conversations.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert tuple(got[0])[1:] == brute_repair([r for r in brute_damage(rows)])


# op13 ----------------------------------------------------------------------------------


def brute_collocations(rows, least, kept):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, table in counts.items():
        phrases = [p for p, f in table.items() if len(p) > 1 and f >= least]
        rows = []
        for p in phrases:
            a, n = table[p], totals[lang]
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(inside(q) and 100 * table[q] >= 100 * a for q in phrases):
                continue
            score, k = min((1000 * a * n // (table[p[:k]] * table[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), table[p[:k]], table[p[k:]], n))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(rows)[:kept], 1)]
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "naïve", "x", "y", "日本"] + [f"w{i}" for i in range(30)]
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(k)) for k in (2, 3, 5, 7, 9)]
    rows = []
    for _ in range(150):
        words = [rng.choice(fixed) if rng.random() < 0.2 else vocabulary[min(int(rng.expovariate(0.15)), 35)] for _ in range(rng.randrange(60))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\r", "\n"]) for w in words), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("alone", "xx")]


@pytest.mark.parametrize("least, kept, table_words, route_rows", [(5, 2000, 1 << 22, 10_000), (5, 2000, 1 << 22, 6), (12, 7, 4, 10), (3, 2000, 1, 1), (4, 50, 2, 50)])
def test_collocations_equal_brute_force(spark, least, kept, table_words, route_rows):
    rows = phrase_rows(least)
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, h int, route int").repartition(5)
    got = collocations.collocations(docs, least, kept, table_words, route_rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, least, kept)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10


def test_collocations_in_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 50)
    rows = phrase_rows(2)
    blobs, langs = [(t or "").encode() for t, _ in rows], __import__("pyarrow").array([g or "und" for _, g in rows])
    hashes, owner, run = collocations._words(langs, blobs, ("run",))
    found, n = np.unique(hashes, return_counts=True)
    words = collocations.WordTable(found, n, True, 0)
    ids, counts, _ = words.look(hashes)
    total = Counter()
    for begin in range(0, len(ids), 50):
        end = min(begin + 54, len(ids))
        goes_on = collocations.pair_keys(ids, run) != 0
        rows_ = collocations._suffix_rows(ids[begin:end], counts[begin:end], goes_on[begin:end], min(50, len(ids) - begin), 10)
        packed = collocations._packed((rows_[1] % np.uint64(7)).astype(np.int32), *rows_[2:])
        held, n, whole = collocations._unpacked(packed, np.dtype(np.uint32))
        for row, k in zip(held.tolist(), n.tolist()):
            total[tuple(v for v in row if v)] += k
    want = Counter()
    for i in range(len(ids)):
        own = [int(ids[j]) for j in range(i, min(i + 5, len(ids))) if run[j] == run[i]]
        if len(own) > 1:
            want[tuple(own)] += 1
    assert total == want


def test_few_pair_slots_and_held_pairs_change_nothing(spark, monkeypatch):
    rows = phrase_rows(9)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "PAIR_SLOTS", 32)
    monkeypatch.setattr(collocations, "RANK_PARTS", 2)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 4, 30).collect()) == brute_collocations(rows, 4, 30)


def test_collocations_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 3).collect())
    assert got == brute_collocations([(r.text, r.lang) for r in docs.collect()], 3, 2000) and got
    assert collocations.collocations(docs.limit(0)).count() == 0 and collocations.collocations(docs).count() == 0
