"""Operators 11, 12 and 13: chat formatting, source divergence, Merkle manifest."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logvane.llm import chat, divergence, merkle, sha

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, term string, part long, idx string"


def docs_of(spark, rows, partitions=3):
    """A table of documents from (doc_id, source, lang, text), with columns that clash in name."""
    filled = [(i, t, g, s, len(t or ""), "x", 1, "y", 2, "z") for i, s, g, t in rows]
    return spark.createDataFrame(filled, DOCS).repartition(partitions)


# --- 11: chat formatting

CHAT = "conv_id long, turn long, role string, text string, formatted string, spans int, part string"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<\\", "[\\\\INST]", "<", "[", " ", "a", "é", "\n", ""]


def chats_of(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CHAT).repartition(partitions)


def digests(rows, part_turns):
    """What reading back must return, from the rows themselves."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(
            len(chat.instruct([(r, t) for _, r, t in turns[k : k + part_turns]]))
            for k in range(0, len(turns), part_turns)
        )
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out.append((conv, len(turns), digest[0], len(loss), digest[1], chars, -(-len(turns) // part_turns), 0))
    return sorted(out, key=repr)


def read(spark, rows, part_turns=chat.PART_TURNS, partitions=3):
    made = chat.format_chats(chats_of(spark, rows, partitions), part_turns=part_turns)
    return sorted(map(tuple, chat.read_back(made).collect()), key=repr)


def test_escapes_undo_themselves_and_leave_no_control_string():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices(CONTROLS, k=draw.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROLS)


def test_chats_against_the_rows_themselves(spark):
    draw = random.Random(2)
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (7, 0, None, None), (8, 3, "tool", ""), (None, None, "user", "q")]
    rows += [(None, 1, "assistant", "a"), (9, 0, "assistant", ""), (10, None, "[INST] ", "x"), (10, None, "user", "tie")]
    rows += [(11, 1, "assistant", "same")] * 5 + [(12, 0, "assistant", "long é\n" * 200_000)]
    rows += [
        (20 + k % 3, k, draw.choice(["user", "assistant", "system", "tool", "[/ROLE]"]), "".join(draw.choices(CONTROLS, k=draw.randint(0, 9))))
        for k in range(200)
    ]
    rows += [(30, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(500)]
    assert read(spark, rows) == digests(rows, chat.PART_TURNS)
    assert read(spark, rows, 3, 1) == digests(rows, 3)
    assert chat.read_back(chat.format_chats(chats_of(spark, rows).limit(0))).collect() == []


def test_spans_of_templates_that_only_append():
    turns = [("system", "be brief"), ("user", "</s> hi"), ("assistant", "[INST]"), ("user", ""), ("assistant", "bye")]
    out, spans, rewritten = chat.render(turns, chat.instruct)
    assert rewritten == [] and spans[0]["begin"] == len(chat.START) and spans[-1]["end"] == len(out)
    assert all(a["end"] == b["begin"] for a, b in zip(spans, spans[1:]))
    assert [chat.unescape(out[s["text_begin"] : s["text_end"]]) for s in spans] == [t for _, t in turns]
    assert [chat.role_of(out[s["begin"] : s["text_begin"]]) for s in spans] == [r for r, _ in turns]


def moves_system(turns):
    """A template that says the system's words in the last user turn, so each user turn rewrites history."""
    system = "".join(t for r, t in turns if r == "system")
    last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
    rest = [(k, r, t) for k, (r, t) in enumerate(turns) if r != "system"]
    return "".join(f"|{r}|{system + '#' if k == last else ''}{t}" for k, r, t in rest)


def drops_early_answers(turns):
    """A template that leaves out all but the last answer."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"|{r}|{t if r != 'assistant' or k == last else ''}" for k, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history_are_detected():
    turns = [("system", "S"), ("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]
    out, spans, rewritten = chat.render(turns, moves_system)
    assert rewritten == [3]
    assert [out[s["text_begin"] : s["text_end"]] for s in spans] == [t for _, t in turns]
    out, spans, rewritten = chat.render(turns, drops_early_answers)
    assert rewritten == [4]
    assert [s["text_begin"] for s in spans][2] == -1
    assert out[spans[4]["text_begin"] : spans[4]["text_end"]] == "four"
    assert chat.render([], moves_system) == ("", [], [])


def test_dropped_answers_are_not_in_the_loss(spark):
    def answers_last(turns):
        last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"|{r}|{t if r != 'assistant' or k == last else ''}" for k, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "gone"), (1, 2, "user", "r"), (1, 3, "assistant", "kept")]
    row = chat.format_chats(chats_of(spark, rows), answers_last).collect()[0]
    assert [s.in_loss for s in row.spans] == [False, False, False, True] and row.rewritten == [3]


# --- 12: source divergence


def audit(rows, fewest, top):
    """All formulas as they stand, over all kept terms of all groups."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, documents, groups = collections.Counter(), collections.Counter(), set()
    for _, source, lang, text in rows:
        source, lang, found = source or "", lang or "", term.findall((text or "").translate(lower))
        groups.add((lang, source))
        counts.update((lang, source, t) for t in found)
        documents.update((lang, t) for t in set(found))
    kept = collections.defaultdict(list)
    for (lang, t), n in documents.items():
        if n >= fewest:
            kept[lang].append(t)

    def shares(lang, count):
        c = {t: count(t) for t in kept[lang]}
        n, v = sum(c.values()), len(c)
        return c, {t: 1 + 1_000_000_000 * (x + 2) // (n + 2 * v) for t, x in c.items()}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, source in groups:
        c, p = shares(lang, lambda t: counts[lang, source, t])
        _, whole = shares(lang, lambda t: sum(counts[lang, s, t] for g, s in groups if g == lang))
        parts = {"pair": [], "term": []}
        for g, other in groups:
            if g == lang and other != source:
                _, q = shares(lang, lambda t: counts[lang, other, t])
                parts["pair"].append((-sum(f(p[t], q[t]) for t in p), other.encode()))
        parts["term"] = [(-f(p[t], whole[t]), t.encode()) for t in p if c[t] > 0 and p[t] > whole[t]]
        for part, items in parts.items():
            for rank, (value, item) in enumerate(sorted(items), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item.decode(), -value, rank))
    return sorted(out)


def audited(docs, **how):
    return sorted(map(tuple, divergence.audit(docs, **how).collect()))


def words_of(draw):
    return [draw.choice(["alpha", "Beta", "gamma", "İx", "naïve", "DELTA", "é", "a\x85b", "z", "the"]) for _ in range(draw.randint(0, 12))]


def test_audit_against_the_formulas(spark):
    draw = random.Random(3)
    sources = [None, "", "s1", "é", "hot", "hot", "hot"]
    rows = [(k, draw.choice(sources), draw.choice(["en", None, "de"]), " 1,".join(words_of(draw))) for k in range(120)]
    rows += [(500, "hot", "en", "alpha " * 60_000), (501, "wordless", "en", "12 -"), (502, "x", "rare", "once"), (503, "y", "rare", None)]
    rows += [(600, "s1", "en", "same same text")] * 12
    want = audit(rows, 10, 10)
    assert audited(docs_of(spark, rows)) == want
    small = {"block": 300, "fan_in": 2, "shards": 3, "sources": 2}
    assert audited(docs_of(spark, rows, 7), **small) == want
    assert audited(docs_of(spark, rows, 1), fewest=3, top=2) == audit(rows, 3, 2)
    assert audited(docs_of(spark, rows).limit(0)) == []


def test_pairs_are_added_up_in_pieces(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(k, f"s{k % 9}", "en", " ".join(words_of(draw))) for k in range(90)]
    monkeypatch.setattr(divergence, "CELLS", 1)
    monkeypatch.setattr(divergence, "MERGED_TERMS", 2)
    assert audited(docs_of(spark, rows), fewest=2) == audit(rows, 2, 10)


def test_runs_are_sorted_and_hold_every_posting(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART_POSTINGS", 7)
    draw = random.Random(5)
    texts = [" ".join(words_of(draw)) for _ in range(60)]
    blocks = [divergence._block([("en", f"s{k % 3}", divergence.terms(t)) for k, t in enumerate(texts[a : a + 10])]) for a in range(0, 60, 10)]
    by_run = collections.defaultdict(list)
    for k, block in enumerate(blocks):
        for batch in divergence._spill(block, str(k), 2):
            for row in batch.to_pylist():
                by_run[row["run"], row["shard"]].append(divergence.Names().open(row))
    assert len(by_run) == 12 and max(map(len, by_run.values())) > 1
    for parts in by_run.values():
        names = [n for p in parts for n in p.names.to_pylist()]
        assert names == sorted(set(names))
    found = collections.Counter()
    for parts in by_run.values():
        for p in parts:
            for name, a, b in zip(p.names.to_pylist(), p.group_ends, p.group_ends[1:]):
                found[name] += int(p.counts[a:b].sum())
    assert found == collections.Counter(w for t in texts for w in divergence.terms(t).split())


# --- 13: Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, text):
    fields = (doc_id, source, lang, len(text or ""), text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def tampered(doc_id, text):
    return text and (text.replace("\n", "") if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text)


def tree(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in order}
    low = {s: levels([leaf(*r) for r in own[s]]) for s in order}
    top = levels([low[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, row in enumerate(own[s]):
            value, siblings = leaf(*row[:3], tampered(row[0], row[3])), []
            if tampered(row[0], row[3]) != row[3]:
                fields = (row[0], s, row[2], len(row[3] or ""), tampered(row[0], row[3]))
                value = digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])
            for nodes, j in ((low[s], i), (top, at)):
                for level in nodes[:-1]:
                    run = level[j // 3 * 3 : j // 3 * 3 + 3]
                    siblings += [x for k, x in enumerate(run) if k != j % 3]
                    run[j % 3] = value
                    value, j = digest(*run), j // 3
            root = top[-1][0]
            out.append((row[0], leaf(*row), low[s][-1][0], root, digest(*siblings), value, value == root))
    return sorted(out, key=repr)


def manifest(docs, height):
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    return sorted((tuple(r)[:7] for r in merkle.manifest(docs, changed, height).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_against_brute_force(spark, height):
    rows = [(k, "hot", "en", f"line {k}\nnext") for k in range(100)]
    rows += [(k, f"s{k % 14}", None, "a\nb" if k % 3 else None) for k in range(200, 260)]
    rows += [(None, None, "en", "x\n"), (5, None, "de", ""), (6, "", "en", "é\n\n"), (7, "é", "en", "long\n" * 100_000)]
    rows += [(9, "same", "en", "copy\n")] * 7 + [(9, "same", "en", "other"), (None, "same", None, None), (None, "same", None, None)]
    assert manifest(docs_of(spark, rows), height) == tree(rows)


def test_manifest_of_few_rows(spark):
    one = [(1, "s", "en", "a\nb")]
    assert manifest(docs_of(spark, one), 8) == tree(one)
    assert manifest(docs_of(spark, one).limit(0), 8) == []


def test_manifest_without_a_change_verifies(spark):
    rows = [(k, f"s{k % 4}", "en", f"text {k}\n") for k in range(40)]
    found = merkle.manifest(docs_of(spark, rows)).collect()
    assert len(found) == 40 and all(r.verified and not r.changed for r in found)


def test_states_resume_as_the_library_does():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(50)]
    lanes, on = sha.words(digests), [True] * 50
    state = sha.absorb(sha.starts(50), lanes, sha.np.array(on))
    kept = sha.words(sha.raw(state))
    after = sha.absorb(kept, lanes[:, ::-1], sha.np.array(on))
    got = sha.raw(sha.close(after, sha.np.full(50, 2)))
    assert got == [hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(digests, digests[::-1])]
