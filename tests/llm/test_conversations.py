import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from sluice.llm.conversations import END, examined, layer, prepared, repaired, repaired_rows, solve, summarised, walk

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(letters):
    """The least in ASCII order of the cheapest edits, by search over (row, state), with up to two inserts before a row."""

    @lru_cache(None)
    def full(i, state):
        options, at, cost, edits = [], state, 0, ""
        for _ in range(3):
            c, s = stay(i, at)
            options.append((cost + c, edits + s))
            at, cost, edits = ("A" if at == "U" else "U"), cost + 3, edits + "I"
        return min(options)

    @lru_cache(None)
    def stay(i, state):
        options = [(0, "")] if i == len(letters) and state in "EA" else []
        if i < len(letters):
            letter, to = letters[i], "A" if state == "U" else "U"
            c, s = full(i + 1, state)
            options.append((4 + c, "D" + s))
            if letter != "-":
                cut = 3 if letter.isupper() else 0
                c, s = full(i + 1, to)
                options.append((c + 3 + cut, "R" + s))
                if letter.lower() == to.lower():
                    options.append((c + cut, "K" + s))
                if letter.lower() == "s" and state == "E":
                    c, s = full(i + 1, "S")
                    options.append((c + cut, "K" + s))
        return min(options, default=(10**6, ""))

    for i in range(len(letters), 0, -1):  # from the end, so that no call goes deep
        for state in "ESUA":
            full(i, state)
    return full(0, "E")


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters, faults = set(), [], []
        for _, role, text in own:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters.append("-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
            faults.append(fault)
        cost, audit = cheapest("".join(letters))
        made, at, state = [], 0, "E"
        for edit in audit:
            to = "A" if state == "U" else "U"
            if edit == "I":
                made.append({"U": "user:", "A": "assistant:"}[to])
                state = to
                continue
            _, role, text = own[at]
            at += 1
            if edit == "R":
                made.append({"U": "user:", "A": "assistant:"}[to] + text)
                state = to
            elif edit == "K":
                made.append(f"{role}:{text}")
                state = {"s": "S", "u": "U", "a": "A"}[role[0]]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(seed, n=400):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", "a.\n ", "été", "日本?", "x. y", None, "\x0b.", "Yes.", "ok.\x0c", "q ", ". "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    out = []
    for conv in [*range(n), None]:
        size = rng.randrange(1, 12)
        turns = [t if rng.random() < 0.95 else rng.choice([None, 0, 3, t + 5]) for t in range(size)]
        out += [(conv, t, rng.choice(["user", "assistant"][i % 2 :][:1] * 6 + roles), rng.choice(texts)) for i, t in enumerate(turns)]
    rng.shuffle(out)
    return out + [(n + 1, 2, "user", "x.")] * 3 + [(n + 2, None, None, None)]


def test_equals_brute_force(spark):
    for seed in range(2):
        given = rows(seed)
        got = sorted(map(tuple, repaired(spark.createDataFrame(given, SCHEMA).repartition(4)).collect()), key=repr)
        assert got == brute(given)


def test_every_short_signature_and_shared_layers():
    every = sorted("".join(x) for n in range(5) for x in itertools.product("suaxSUA-", repeat=n))
    for signature, cost, audit in solve(iter(every)):
        assert (cost, audit) == cheapest(signature[::-1]), signature


def test_layers_are_computed_once_for_a_shared_prefix(monkeypatch):
    import sluice.llm.conversations as module

    made = []
    monkeypatch.setattr(module, "layer", lambda after, letter: made.append(letter) or layer(after, letter))
    list(solve(iter(sorted(["aua" * 50 + x for x in ("", "s", "u", "us", "uss")]))))
    assert len(made) == 150 + 1 + 3  # the shared part, s, and u, us, uss


def test_long_signature():
    signature = "au" * 200_000 + "s"
    (_, cost, audit), = solve(iter([signature]))
    assert cost == 0 and audit == "K" * len(signature)
    layers = [END]
    for letter in "a-":
        layers.append(layer(layers[-1], letter))
    assert walk(layers, "a-") == "DIK"


def test_all_rows_gone_and_empty_table(spark):
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = repaired(spark.createDataFrame([(5, dropped, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_alternate_and_clashing_columns(spark):
    given = [(*r, "x", 1) for r in rows(5, 80)]
    frame = spark.createDataFrame(given, SCHEMA + ", head string, seq int")
    out = {}
    for r in repaired_rows(*prepared(frame)).collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"][:1]))
    assert out
    for own in out.values():
        assert [p for p, _ in sorted(own)] == list(range(1, len(own) + 1))
        assert re.fullmatch("s?(ua)+", "".join(x for _, x in sorted(own)))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repaired(frame).collect()}
    assert all(digests[c] == hashlib.sha256(b"").hexdigest() for c in digests if c not in out)


def test_a_conversation_of_many_blocks(spark):
    given = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(5000)]
    frame = spark.createDataFrame(given, SCHEMA)
    assert [tuple(r) for r in repaired(frame).collect()] == brute(given)


def test_summary_before_the_repair(spark):
    from sluice.llm.conversations import damaged

    every = damaged(spark.createDataFrame([(1, 1, "user", "a."), (1, 5, "user", "b")], SCHEMA))
    row = summarised(every, examined(every)).first()
    assert row["gaps"] == 3 and row["signature"].lower() == "uu"
