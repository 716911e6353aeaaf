"""Fingerprints and conversation repair against brute force: op12, op13."""

import hashlib
import random
import re
import zlib

import numpy as np

from rivalry.llm import conversations, fingerprints

BLANK = re.compile(r"[^\x20\x09-\x0D]")
DOCS = "doc_id long, text string, source string, tie string, range_no string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", "clash") for r in rows], DOCS)


def brute_vector(text):
    out = np.zeros(fingerprints.EQUAL + fingerprints.LIKE, dtype=object)
    for p in text.split("\n"):
        digest = b"".join(hashlib.sha256(f"{i}:{p}".encode()).digest() for i in range(4))
        for j in range(32):
            out[j] += int.from_bytes(digest[4 * j:4 * j + 4], "big")
        code = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", p)]
        for i in range(max(min(len(code), 1), len(code) - 4)):
            z = sum(c * 31**j for j, c in enumerate(code[i:i + 5])) % 2**32
            out[32 + z // 2**24] += -1 if z // 2**23 % 2 else 1
    return out


def test_half_edits(spark):
    rng = random.Random(4)
    words = ["a", "bé", "日本", "😀", "x.", "tail"]
    texts = ["", None, "\n", " \t\n\n ", "one", "a\r\nb c", "w " * 4000 + "\n" * 300 + "long " * 3000, "😀" * 9]
    texts += ["\n".join(" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(rng.randrange(6))) for _ in range(150)]
    rows = [(i * 3 % 400, t) for i, t in enumerate(texts)] + [(None, "none"), (None, None), (7, "twice"), (7, "twice"), (7, "else")]
    df = docs(spark, rows).repartition(5)
    for range_bytes in (1 << 24, 300):  # one range, and many
        got = fingerprints.half_edits(df, range_bytes=range_bytes).collect()
        ties = {(r.doc_id, r.t): r.h for r in df.selectExpr("doc_id", "coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
        order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r]))
        want = []
        for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
            half = len(t) // 2
            e = t[:len(t) - half] + n[:half]
            v = [brute_vector(x) for x in (t, e, n)]
            like = []
            for w in v[1:]:
                x, y = v[0][32:], w[32:]
                both = sum(x * x) + sum(y * y)
                same = all(a % 2**32 == b % 2**32 for a, b in zip(v[0], w))
                like.append(1.0 if same else min(1.0, max(0.0, 2.0 * int(sum(x * y)) / int(both))) if both else 0.0)
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *["".join(f"{x % 2**32:08x}" for x in w) for w in v[:2]], *like))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.half_edits(df.where("false")).count() == 0
    alone = fingerprints.half_edits(docs(spark, [(1, "a b c d")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 7


def test_paragraphs_are_added_and_removed():
    whole, part, other = fingerprints.vectors(["x y\nz", "z", "z\nx y"])
    assert (whole == other).all() and (fingerprints.delete(whole, part) == fingerprints.vectors(["x y"])[0]).all()
    assert (fingerprints.insert(fingerprints.delete(whole, part), part) == whole).all()
    long = fingerprints.vectors(["\n".join(f"line {i % 7}" for i in range(fingerprints.STEP * 2 + 5))])[0]
    counts = np.bincount(np.arange(fingerprints.STEP * 2 + 5) % 7)
    lines = fingerprints.vectors([f"line {i}" for i in range(7)])
    assert (long == (lines * counts[:, None].astype(np.uint32)).sum(axis=0, dtype=np.uint32)).all()


def brute_repair(rows):
    """rows: (turn, role, text) after damage, in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        kinds.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    after, final = (2, 2, 3, 2), (True, False, False, True)
    kept = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for _ in range(4):  # insertions chain three deep at most
            for q in range(4):
                ways = [(0, "")] if i == len(rows) and final[q] else []
                if i < len(rows):
                    bad = 5 * (kinds[i] == "t")
                    ways.append((best[i + 1][q][0] + 2, "D" + best[i + 1][q][1]))
                    if kinds[i] in ("", "t"):
                        to = kept.get(rows[i][1][:1], (None,) * 4)[q]
                        if to is not None:
                            ways.append((best[i + 1][to][0] + bad, "K" + best[i + 1][to][1]))
                        ways.append((best[i + 1][after[q]][0] + 1 + bad, "R" + best[i + 1][after[q]][1]))
                if best[i][after[q]] is not None:
                    ways.append((best[i][after[q]][0] + 5, "I" + best[i][after[q]][1]))
                best[i][q] = min(ways, default=None)
    cost, audit = best[0][0]
    lines, q, at = [], 0, 0
    for e in audit:
        if e == "I":
            q = after[q]
            lines.append(["", "", "user", "assistant"][q] + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if e == "K":
            q = kept[role[0]][q]
            lines.append(f"{role}:{text}")
        elif e == "R":
            q = after[q]
            lines.append(["", "", "user", "assistant"][q] + ":" + text)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def conversation_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for i in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "unknown", "user"])
            text = rng.choice(["Yes.", "No", "", None, " \t\n", "Well!  \n", "So?", "日本。", "a:b\nc.", "same."] + [f"t{rng.randrange(40)}." for _ in range(20)])
            rows.append((conv, rng.choice([i, i, i, i + 1, None, 2 * i]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, part int").repartition(6)


def check(spark, rows):
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damage(frame(spark, rows))).collect()}
    want = {c: brute_repair(brute_damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want


def test_conversations(spark):
    rows = conversation_rows(1, [*range(120), None], 14)
    rows += [(500, 0, "user", "x" * 200_000 + "."), (500, 1, "assistant", "y\n" * 50_000)] + [(501, 5, "user", "Again.")] * 40
    check(spark, rows)
    assert conversations.repair(conversations.damage(frame(spark, rows[:1]).where("false"))).count() == 0


def test_conversations_across_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    monkeypatch.setattr(conversations, "RANGE_ROWS", 15)
    check(spark, conversation_rows(2, [*range(12), None], 90) + [(7, 3, "user", "Hot.")] * 50)


def test_search_in_blocks_equals_search_in_one():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.randrange(9) for _ in range(rng.randrange(1, 24))]
        counts = [rng.randrange(1, 4) if c == 0 else 1 for c in codes]
        cost, _, edits = conversations.search(codes, counts, 0, conversations.FINAL, True)
        cut = rng.randrange(len(codes) + 1)
        table = conversations.block_costs(codes[cut:], counts[cut:])
        exits = tuple(min(table[4 * a + b] + conversations.FINAL[b] for b in range(4)) for a in range(4))
        head = conversations.search(codes[:cut], counts[:cut], 0, exits, False)
        tail = conversations.search(codes[cut:], counts[cut:], head[1], conversations.FINAL, True)
        assert (head[0], head[2] + tail[2]) == (cost, edits)
