"""The conversation trie against a plain version, with hash and fingerprint collisions, and its rules for odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairloom.llm import turntrie
from pairloom.llm.turntrie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, c long, depth long, h string"
EXTRA = ("x", 1, 2, "y")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        inner = {k[:-1] for k in nodes if k}
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        out.add(
            (min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(k[:-1] == key and k != () for k in nodes), sum(k not in inner for k in below), sum((len(nodes[k]) - 1) * words(k) for k in below), hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def made(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(140), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b b", "a"]) if t < 4 else rng.choice(["tail x", "", "b"])))
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 202, 203, 204) for t in range(5)]
    return rows


def found(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


ODD = [
    (None, 1, "user", "no id"),
    (7, None, "user", "null turn"), (7, None, None, None), (7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (7, 3, "bot", "tie z"),
    (7, 4, "user", "twice"), (7, 4, "user", "twice"), (7, 5, "x", "ab c"), (7, 5, "xa", "b c"),
    (-5, 0, "user", "negative"), (-5, 1, "user", "negative"), (8, 0, None, "word " * 40_000),
]


def test_trie_matches_plain_version_with_odd_rows(spark):
    rows = made() + ODD
    got = prefix_trie(frame(spark, rows))
    assert got.count() == len(brute(rows))
    assert found(got) == brute(rows)


@pytest.mark.parametrize("primes,bits", [((3, 5), 64), ((7, 11), 2)])
def test_colliding_groups_are_split(spark, primes, bits):
    """Fifteen fingerprints, or four turn hashes, for some hundred prefixes."""
    rows = made(30, 5)
    assert found(prefix_trie(frame(spark, rows), primes=primes, hash_bits=bits)) == brute(rows)


def test_long_conversations_and_lists_in_pieces(spark, monkeypatch):
    """Chunks of three turns, pieces of two ids: what earlier ones add up to is carried on."""
    monkeypatch.setattr(turntrie, "CHUNK", 3)
    monkeypatch.setattr(turntrie, "PIECE", 2)
    rows = made(20, 7) + [(300 + i, t, "user", f"long {t} {'x' if t > 20 + i % 2 else ''}") for i in range(7) for t in range(30)]
    assert found(prefix_trie(frame(spark, rows))) == brute(rows)


def test_scan_goes_on_over_batches():
    import pandas as pd

    rng = np.random.default_rng(1)
    f = pd.DataFrame({"c": np.repeat([1, 2, 3], [50, 1, 49]), "chunk": 0, "depth": np.r_[1:51, 1, 1:50], "h": rng.integers(-(2**63), 2**63 - 1, 100), "v": 0, "w": rng.integers(0, 9, 100), "length": 50})
    whole = pd.concat(turntrie.scan_prefixes()([f]))
    cut = pd.concat(turntrie.scan_prefixes()([f[:20], f[20:20], f[20:51], f[51:]]))
    assert (whole[["f0", "f1", "b0", "b1", "words"]].to_numpy() == cut[["f0", "f1", "b0", "b1", "words"]].to_numpy()).all()
    for i, (p, b) in enumerate(zip(turntrie.PRIMES, turntrie.BASES, strict=True)):
        total = 0
        for d, h in zip(f.depth[:50], f.h[:50], strict=True):
            total = (total + (int(h) % 2**64) % p * pow(b, int(d), p)) % p
            assert whole[f"f{i}"].iloc[d - 1] == total


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    # crc32("3") % 4 is 3: one turn of its own, none to borrow, so nothing is left
    assert zlib.crc32(b"3") % 4 > 1
    rows = [(3, 0, "user", "only")]
    assert found(prefix_trie(frame(spark, rows))) == brute(rows)
