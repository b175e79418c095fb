"""Conversations and question-answer pairs."""

import random
from datetime import datetime, timedelta

import pytest

from quillgraph.llm import conversations as CV
from quillgraph.llm import pairs as PA

T = datetime(2024, 3, 1)
MSG = "id string, chatId string, role string, content string, tokenCount int, createdAt timestamp, kind string"


def rows_of(chat, *turns, start=T, step=20):
    return [(f"{chat}-{i}", chat, r, c, None, t if t is None or isinstance(t, datetime) else start + timedelta(minutes=step * i), "clash") for i, (r, c, t) in enumerate((*x, 0)[:3] for x in turns)]


def brute(messages, chats):
    order = {"system": 0, "user": 1, "assistant": 2, "unknown": 3}
    kinds = {s: k for k, v in CV.ROLES.items() for s in v}
    best = {}
    for i, c, r, t, _, at, _k in messages:
        k = (at is None, at or T, c or "")
        if i not in best or k < best[i][0]:
            best[i] = (k, (c, kinds.get((r or "").strip().lower(), "unknown"), bool(t) and any(x.isalnum() for x in t), at))
    by = {}
    for _, (c, k, s, at) in best.values():
        if c is not None:
            by.setdefault(c, []).append((at, order[k], k, s))
    out = {}
    for c in set(by) | set(chats):
        v = by.get(c, [])
        turns = [x for x in sorted((x for x in v if x[0]), key=lambda x: x[:2]) if x[2] != "system"]
        if not any(x[2] in ("user", "assistant") and x[3] for x in v):
            out[c] = "empty"
        elif c not in chats or any(x[0] is None or x[2] == "unknown" for x in v) or turns[0][2] != "user" or any(a[2] == b[2] == "assistant" for a, b in zip(turns, turns[1:])):
            out[c] = "broken"
        elif any(a[2] == "user" and not (b and b[2] == "assistant" and b[3]) for a, b in zip(turns, [*turns[1:], None])):
            out[c] = "missing_reply"
    return out


def test_judgement_equals_brute_force(spark):
    rng = random.Random(2)
    msgs, chats = [], []
    for n in range(150):
        c = f"c{n}"
        if rng.random() < 0.9:
            chats.append(c)
        for i in range(rng.randint(0, 6)):
            role = rng.choice(["user", "assistant", "user ", "Bot", "system", "human", "ai"] if rng.random() < 0.95 else ["tool", None])
            at = T + timedelta(minutes=rng.randint(0, 8) * 25 + i * 60 * rng.randint(0, 1)) if rng.random() < 0.97 else None
            m = (f"{c}-{i}", c, role, rng.choice(["hi", "yes.", "", None, "...", "ok"]) if rng.random() < 0.3 else "text", 1, at, "k")
            msgs += [m] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(msgs, MSG)
    got = {r.chatId: r.reason for r in CV.judged(df, spark.createDataFrame([(c, "t") for c in chats + [None]], "id string, content string")).where("reason is not null").collect()}
    assert got == brute(msgs, chats)


def test_turns_are_numbered_across_hours(spark):
    m = rows_of("c", ("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "a2"), step=50)
    t = CV.ordered_turns(spark.createDataFrame(m, MSG), spark.createDataFrame([("c",)], "id string")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.id) for r in t] == [(1, "user", "c-0"), (2, "assistant", "c-1"), (3, "user", "c-2"), (4, "assistant", "c-3")]


def test_clock_offsets(spark):
    m = rows_of("c", ("assistant", "a", T), ("user", "q", T + timedelta(seconds=30)))
    df = spark.createDataFrame(m, MSG)
    o = CV.clock_offsets(CV.one_per_id(df), 600.0).first()
    assert (o.constraints, o.violated, o.offset) == (1, 1, 30.0)
    chats = spark.createDataFrame([("c",)], "id string")
    assert CV.judged(df, chats).first().reason == "broken" and CV.judged(df, chats, 600.0).first().reason is None


def test_clock_pairs_cross_hours(spark):
    at = lambda h, m: datetime(2024, 3, 1, h, m)
    over = rows_of("c", ("user", "q", at(10, 59)), ("assistant", "a", at(11, 1)), ("user", "q", at(11, 10)), ("assistant", "a", at(11, 12)))
    rng = random.Random(6)
    more = [(f"d-{i}", "d", rng.choice(["user", "assistant"]), "x", None, T + timedelta(minutes=rng.randint(0, 600)), "k") for i in range(60)]
    got = {r.chatId: r for r in CV.clock_offsets(CV.one_per_id(spark.createDataFrame(over + more, MSG)), 1e9, 40).collect()}
    assert (got["c"].constraints, got["c"].violated, got["c"].offset, got["c"].feasible) == (3, 0, 0.0, True)
    u, a = ([(x - T).total_seconds() for x in sorted(m[5] for m in more if m[2] == r)] for r in ("user", "assistant"))
    lo, hi = [x - y for x, y in zip(u, a)], [x - y - 1e-6 for x, y in zip(u[1:], a)]
    assert (got["d"].constraints, got["d"].violated, got["d"].feasible) == (len(lo) + len(hi), sum(x > 0 for x in lo) + sum(x < 0 for x in hi), False)
    cost = lambda d: sum(max(0, x - d) ** 2 for x in lo) + sum(max(0, d - x) ** 2 for x in hi)
    best = min(cost(d * 10.0) for d in range(-4000, 4000))
    assert cost(got["d"].offset) <= best * 1.0001


def test_planted_skew_is_found_and_rescued(spark):
    rng = random.Random(4)
    rows, skew = [], {}
    for n in range(30):
        c, skew[c] = f"c{n:02d}", rng.choice([0, 0, -90, -240, 120, 5000])
        t = T + timedelta(minutes=rng.randint(0, 600))
        for i in range(6):
            t += timedelta(seconds=rng.randint(20, 80))
            rows.append((f"{c}-{i}", c, "user" if i % 2 == 0 else "assistant", "text", None, t + timedelta(seconds=skew[c] if i % 2 else 0), "k"))
    df, chats = spark.createDataFrame(rows, MSG), spark.createDataFrame([(c,) for c in skew], "id string")
    got = {r.chatId: r for r in CV.clock_offsets(CV.one_per_id(df), 600.0).collect()}
    assert all(r.feasible for r in got.values())
    dropped = {r.chatId for r in CV.judged(df, chats).where("reason is not null").collect()}
    assert dropped and {c for c in skew if skew[c] == 0}.isdisjoint(dropped)
    saved = {r.chatId for r in CV.rescued(df, chats, 600.0).collect()}
    assert saved == {c for c in dropped if abs(skew[c]) < 600}
    turns = CV.ordered_turns(df, chats, 600.0).collect()
    assert all(r.id == f"{r.chatId}-{r.turn - 1}" for r in turns) and {r.chatId for r in turns} == saved | set(skew) - dropped


Q = "Which decision covers the annual audit report of the branch?"
AR = "ما هو القرار الذي يغطي تقرير التدقيق السنوي؟"


@pytest.mark.parametrize(
    "q,a,want",
    [
        (Q, None, {"empty"}), (Q, "  ​ ", {"empty"}), (Q, "...", {"empty"}), (Q, Q, {"copy"}), (Q, f"{Q}\n{Q}", {"copy"}), (Q, f"You asked: {Q}", {"copy"}), (Q, Q + " The audit is covered by decision five and its annex.", set()),
        (Q, "The decision covers the audit and the", {"truncated"}), (Q, "The decision covers it. [circ", {"truncated"}), (Q, "The decision covers it. [circular-c01]", set()), (Q, "Steps:\n1. First item\n2.", {"truncated"}), (Q, "Steps:\n1. First item\n2. Second", set()),
        (Q, "I'm afraid I can't say anything about audits.", {"refusal"}), (Q, "A branch cannot refuse such a request.", set()), (Q, "Sorry for the confusion. The decision covers the audit.", set()), (AR, "للأسف لا يسعني الحديث عن التدقيق.", {"refusal"}),
        (Q, "القرار رقم خمسة يغطي التقرير.", {"language"}), (Q + " Please reply in Arabic.", "القرار رقم خمسة يغطي التقرير.", set()), (Q, "Selon la décision, le service doit vérifier les dossiers.", {"language"}), (AR + " (أجب بالإنجليزية)", "Decision five.", set()), ("???", "Yes.", set()), (None, "Yes.", set()),
        (Q, "I am sorry, but I cannot answer this question. " + "The branch keeps its ledgers in order and files them every month. " * 8, {"refusal"}), (Q, "The decision covers the audit. " * 9 + "A transfer beyond the scope of this rule is void.", set()),
        (Q, "Sorry, but the passages are silent on the matter. Please ask the treasury desk. Anything else?", {"refusal"}),
        (Q, "<ul><li>First point of the rule is set out here.", {"truncated"}), (Q, "<ul><li>First point of the rule.</li></ul>", set()), (Q, "<p>The rule is set out in <b>clause 5</b>.", set()), (Q, "The levels:\n1. First:\n   - one\n   - two\n2. Second:", {"truncated"}), (Q, "The levels:\n1. First:\n   - one\n   - two", set()),
        (Q, "Die Entscheidung betrifft den Bericht und wird von der Bank nach der Prüfung veröffentlicht.", {"language"}), (Q, "La decisión cubre el informe y debe ser publicada por el banco después de la auditoría.", {"language"}), (Q + " Please answer in German.", "Die Entscheidung betrifft den Bericht und wird von der Bank veröffentlicht.", set()),
        (Q, "\n".join([Q] * 9), {"copy"}), (Q, "The **decision covers the audit.", {"truncated"}),
    ],
)
def test_defects(spark, q, a, want):
    got = PA.defects_of(spark.createDataFrame([("x", q, a, 1)], "id string, question string, answer string, copy int"))
    assert {r.defect for r in got.collect()} == want


def test_pairs_skip_system_rows_and_undated_chats(spark):
    m = rows_of("c", ("user", "q"), ("system", "s"), ("assistant", "a"), ("assistant", "b"), step=45) + rows_of("d", ("user", "q"), ("assistant", "a"), ("user", "x", None))
    got = {(r.id, r.question, r.answer) for r in CV.question_answer_pairs(spark.createDataFrame(m, MSG)).collect()}
    assert got == {("c-2", "q", "a")}
    assert PA.pair_defects(spark.createDataFrame([], MSG)).count() == 0


def test_parser():
    assert PA.unfinished("```\ncode") and not PA.unfinished("```\ncode\n```") and PA.unfinished('He said "yes.') and not PA.unfinished("1) ok\n2) fine.") and not PA.unfinished("OK") and PA.unfinished("one two three")
    assert PA.tiles("a b c d".split(), "x a b c".split()) == (3, 3)
    assert PA.tiles("a b c a b c".split(), "a b c".split()) == (6, 3) and PA.tiles("a b".split(), "a b".split()) == (2, 2) and PA.tiles("a x b y".split(), "a b x".split()) == (0, 0)
    words = [f"w{i % 977}" for i in range(40_000)]
    assert PA.tiles(words, words) == (40_000, 40_000)
