import hashlib
import random
import re

import pytest

from lectern.llm import secret_scan as ss


def plain_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def texts():
    rnd = random.Random(7)
    parts = ["token = \"abcdefghijkl\"", "PASSWORD:'short'", "secret=secret=abcdefghijklmnop", "AKIA" + "A1" * 8, "AKIAAKIA", "0123456789abcdef0", "deadbeef", "apiKey : x-y_z.1234567", "\n\n", " ", "é", "word", "ſecret=abcdefghijklmnop", "user: admin", "host=db.example.org", "pwd=hunter2!"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(400)] + ["", "x" * 100_000 + "token=abcdefghijklmnop", "0a" * 50_000]


def test_base_matches_plain_patterns():
    for t in texts():
        assert sorted(ss.strong(t), key=lambda s: (s[1], ss.KINDS.index(s[0]))) == plain_base(t)


def plain_linked(text, base, reach=ss.REACH):
    """All pairs of parts."""
    weak = [("identifier", *m.span()) for m in ss.WEAK_IDENTIFIER.finditer(text)] + [("weak_secret", *m.span()) for p in (ss.WEAK_SECRET, ss.BARE_SECRET) for m in p.finditer(text)] + [("endpoint", *m.span()) for m in ss.ENDPOINT.finditer(text)]
    weak = [w for w in weak if not any(w[1] < b and a < w[2] for _, a, b in base)]
    breaks = [m.start() for m in ss.EMPTY_LINE.finditer(text)]
    scope = lambda at: sum(b <= at for b in breaks)
    limits = [0, *breaks, len(text)]

    def near(role, s):
        k = scope(s[1])
        low, high = max(s[1] - reach, limits[k]), min(s[2] + reach, limits[k + 1])
        return any(ss.ROLE[o[0]] == role and o[1] < high and low < o[2] for o in [*base, *weak])

    needs = {"weak_secret": ["identifier"], "identifier": ["secret"], "endpoint": ["identifier", "secret"]}
    return sorted(s for s in weak if all(near(r, s) for r in needs[s[0]]))


def test_links_match_all_pairs():
    seen = 0
    for t in texts():
        base = ss.strong(t)
        got = sorted(ss.linked(t, base))
        assert got == plain_linked(t, base)
        seen += len(got)
    assert seen > 50


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("user: admin\npwd=hunter2!\nhost=db.example.org", ["identifier", "weak_secret", "endpoint"]),
        ("user: admin\n\npwd=hunter2!", []),
        ("pwd=hunter2!", []),
        ("host=db.example.org user: admin", []),
        ("user: admin " + "x " * 300 + "pwd=hunter2!", []),
        ("AKIA" + "B" * 16 + " wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab", ["access", "weak_secret"]),
        ("the clean text says nothing: at all", []),
    ],
)
def test_weak_parts_need_each_other(text, kinds):
    base, more = ss.find(text)
    assert [k for k, _, _ in sorted(base + more, key=lambda s: s[1])] == kinds


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "token=abcdefghijklmnop"), (900, None), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id bigint, text string, n_chars bigint, secrets string")
    got = ss.op6_secret_scan(df).collect()
    assert len(got) == len(rows)
    said = {}
    for d, t in rows:
        base = plain_base(t)
        said.setdefault(d, []).append((sum(k == "assign" for k, *_ in base), sum(k == "access" for k, *_ in base), sum(k == "hex" for k, *_ in base), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), ss.listed([s for own in ss.find(t) for s in own])))
    for d, want in said.items():
        assert sorted(tuple(r)[1:] for r in got if r.doc_id == d) == sorted(want)
    hidden = ss.redacted(df)
    assert hidden.columns == df.columns
    for r in hidden.collect():
        assert r.text is None or (not plain_base(r.text) and r.n_chars == len(r.text))
    assert ss.op6_secret_scan(df.limit(0)).collect() == []


LINES = "".join(f"option_{i} = value {i}\n" for i in range(60))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("user: admin\n" + LINES + "pwd=hunter2!", ["identifier", "weak_secret"]),
        ('{"user": "admin", ' + '"colour": "red and green", ' * 60 + '"pwd": "hunter2!"}', ["identifier", "weak_secret"]),
        ("AKIA" + "B" * 16 + "\n" + LINES + "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab", ["access", "weak_secret"]),
        ("[default]\nuser = admin\n\n" + LINES + "\n# the other part\npwd = hunter2!", ["identifier", "weak_secret"]),
        ("[default]\nuser = admin\n\nSome words follow.\n\npwd = hunter2!", []),
        *[("AKIA" + "B" * 16 + " " + ("aB3+" * 20)[: n - pad] + "=" * pad, ["access", "weak_secret"]) for n, pad in ((24, 0), (44, 1), (64, 0), (80, 0))],
    ],
)
def test_scope_alone_bounds_the_join(text, kinds):
    base, more = ss.find(text)
    assert [k for k, _, _ in sorted(base + more, key=lambda s: s[1])] == kinds


def test_many_empty_lines_take_time_by_their_number():
    import time

    parts = "[section]\nuser_name = someone\n{}password = abcdef1\n"
    blank, took = "\n \t" * 200_000, time.perf_counter()
    found = ss.find(parts.format(blank + "\n"))[1]
    assert time.perf_counter() - took < 10
    assert [k for k, _, _ in found] == ["identifier", "weak_secret"] == [k for k, _, _ in ss.find(parts.format("\n\n"))[1]]
    # Without a labelled line after them empty lines end the section.
    assert ss.find("[section]\nuser_name = someone\n" + blank + "\nprose, and then\npassword = abcdef1\n")[1] == []
