"""Source divergence, chat formatting and fill-in-middle against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantweft.llm import chat, divergence, infill

DOCS = "doc_id long, text string, lang string, source string, n string, rank int, item string, vector string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# operator 11


def plain_divergence(rows, least, ranks):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    within, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        within[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, ranks)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "béta", "ÉTÉ", "x1y", "don't", "ß", "zeta-eta", "字", "𝒳", "rare%d"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words).replace("%d", str(rng.randint(0, 9))) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "é", None, "Z"]), "n", 1, "i", None))
    rows += rows[:7] + [(None, None, None, None, None, None, None, None), (500, "one " * 40_000, "en", "a", None, None, None, None), (501, "lonely words", "xx", "only", None, None, None, None), (502, "", "yy", "s1", None, None, None, None), (503, "1 2", "yy", "s2", None, None, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "kept", "small"), [(1, 600_000, True), (2, 7, False)])
def test_divergence_like_big_integers(spark, monkeypatch, seed, kept, small):
    """Counters that are flushed often, and lists that are joined without a broadcast, give the same."""
    if not small:
        monkeypatch.setattr(divergence, "MOST_BYTES", -1)
    rows = audit_rows(seed)
    audit = divergence.Audit(spark.createDataFrame(rows, DOCS), least=3, kept=kept)
    assert sorted(tuple(r) for r in audit.result(ranks=4).collect()) == plain_divergence(rows, 3, 4)


def test_share_of_large_counts(spark):
    """SCALE * count does not fit a long."""
    row = spark.range(1).select(F.lit(9 * 10**14).alias("n"), F.lit(10**16 + 7).alias("total")).select(F.expr(divergence._p("n", "total"))).first()
    assert row[0] == 1 + 10**9 * (9 * 10**14 + 1) // (10**16 + 7)


def test_divergence_of_nothing(spark):
    out = divergence.divergence(spark.createDataFrame([], DOCS))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert out.count() == 0


# operator 12

ODD_TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST] <", "[", "<s", "[TEXT]a[/TEXT][ROLE]", "é\n\n𝒳 ", " lead and trail ", "<[INST]>", "[/INST", "\\"]


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["[", "<", "\\", "/", "INST]", "ROLE]", "TEXT]", "s>", "a", "]", ">"]) for _ in range(rng.randint(0, 12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not chat._MARK.search(escaped)
        assert list(chat.turns(chat.rendered("user", text)[0] + chat.rendered(text, text)[0])) == [("user", text), (text, text)] or text in ("user", "assistant")


def replayed(events):
    """Messages of one conversation: all events in the order of seq."""
    texts, roles = {}, {}
    for seq, place, copy, kind, role, text in sorted(set(events)):
        key = (place, copy)
        if role is not None:
            roles[key] = role
        if kind == "regenerate":
            for other in [k for k in texts if k[0] > place]:
                del texts[other]
            texts[key] = ""
        else:
            texts[key] = (texts.get(key, "") if kind == "delta" else "") + (text or "")
    return [(roles.get(k, ""), texts[k]) for k in sorted(texts)]


def random_log(seed):
    rng = random.Random(seed)
    logs = {}
    for conv in [None, *range(25)]:
        events = []
        for seq in range(rng.randint(1, 40)):
            kind = rng.choices(["start", "delta", "edit", "regenerate"], [3, 6, 1, 1])[0]
            role = rng.choice(["user", "assistant", "system", "tool\nx", "[ROLE]", None]) if kind == "start" else None
            events.append((seq, rng.randint(0, 5), rng.choice([0, 0, 0, 1]), kind, role, rng.choice([*ODD_TEXTS, None])))
        logs[conv] = events
    return logs


@pytest.mark.parametrize(("seed", "part"), [(1, 1 << 20), (2, 1), (3, 40)])
def test_fold_like_a_replay(spark, seed, part):
    logs = random_log(seed)
    rng = random.Random(seed)
    rows = [(conv, place, copy, seq, kind, role, text, "x", 1) for conv, events in logs.items() for seq, place, copy, kind, role, text in [*events, *events[:5]]]
    rows += [(3, 1, 0, 999, None, None, "no kind", "x", 1), (3, 1, 0, 1000, "other", None, "another kind", "x", 1)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, message long, copy long, seq long, kind string, role string, text string, part string, loss int")
    formatted = chat.format_chats(log, part)
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    parts = defaultdict(list)
    for r in formatted.collect():
        parts[r.conv_id].append(r)
    assert found.keys() == logs.keys()
    for conv, events in logs.items():
        turns = replayed(events)
        learnt = "".join(t for r, t in turns if r == "assistant")
        row = found[conv]
        assert [x.part for x in parts[conv]] == list(range(len(parts[conv])))
        assert [t for x in parts[conv] for t in chat.turns(x.text)] == turns
        assert [chat.unescape(x.text[s.start : s.stop]) for x in parts[conv] for s in x.loss] == [t for r, t in turns if r == "assistant"]
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), sha(learnt))
        assert row.formatted_chars == sum(len(x.text) for x in parts[conv])


def test_tables_of_turns(spark):
    """Nulls, repeated rows, long texts, clashing columns, and a text that is streamed in pieces of one character."""
    rows = [(1, 0, "user", t, i) for i, t in enumerate(ODD_TEXTS)] + [(1, 1, "assistant", "ab" * 70_000, 0), (1, 2, None, None, 0), (None, None, "assistant", "x", 0), (None, 5, "user", None, 0), (2, 3, "assistant", "same", 0), (2, 3, "assistant", "same", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long").coalesce(1)
    for delta in (1 << 20, 3):
        found = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.streamed(table, delta))).collect()}
        turns = {1: [("user", t) for t in ODD_TEXTS] + [("assistant", "ab" * 70_000), ("", "")], None: [("assistant", "x"), ("user", "")], 2: [("assistant", "same")] * 2}
        assert {k: (r.n_turns, r.turns_sha256) for k, r in found.items()} == {k: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t))) for k, t in turns.items()}
    empty = spark.createDataFrame([], table.schema)
    assert chat.read_back(chat.format_chats(chat.streamed(empty))).count() == 0
    assert [r.n_turns for r in chat.read_back(chat.format_chats(chat.streamed(chat.with_probe(empty)))).collect()] == [2]


# operator 13


def plain_units(text, unit):
    return list(text) if unit == "chars" else re.findall({"words": r"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+\Z", "lines": r"[^\n]*\n|[^\n]+\Z"}[unit], text)


TEXTS = [None, "", "a", "é", "𝒳字é a", "two words", " \n ", "line one\nline two\n\nlast", "has <S> inside", "<P", "<M>", "ab\n" * 5000 + "end", "𝒳é " * 40_000, "x" * 9000, "\x00 nul"]


@pytest.mark.parametrize(("unit", "stride"), [("chars", 4096), ("chars", 3), ("words", 7), ("lines", 2)])
def test_infill_like_slices(spark, unit, stride):
    rows = [(i, TEXTS[i % len(TEXTS)], "x", "y", 1) for i in range(150)] + [(None, "no id at all", "x", "y", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n long")
    made = infill.infill(docs, unit, stride=stride)
    found = made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    forms = Counter()
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        units = plain_units(text, unit)
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = ("".join(units[x]) for x in (slice(0, a), slice(a, b), slice(b, None)))
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        forms[form] += 1
        expected[doc_id, n, form, None if plain else len(prefix), None if plain else len(middle), output, text] += 1
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in found) == expected
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 5


def test_every_cut_of_a_sparse_index(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 11)
    for text in ["", "a", "é𝒳a字" * 9, "one two  three\n four " * 5]:
        for unit in ("chars", "words", "lines"):
            units = plain_units(text, unit)
            index = infill.Checkpoints(text.encode(), unit, stride=4)
            assert (index.n, index.n_points) == (len(units), len(text))
            assert len(index.units) <= len(units) // 4 + 1
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert index.cut(k) == (len(before.encode()), len(before))


def test_infill_of_nothing(spark):
    assert infill.infill(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="unknown unit"):
        infill.infill(spark.createDataFrame([], "doc_id long, text string"), "pages")
