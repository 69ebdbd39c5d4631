"""Secret scans: strong patterns, and multipart credentials linked by interval joins within scopes.

Strong spans (assign, access, hex) are reported as they are. Weak candidates are parts of credentials that alone mean
little: a user name or client id, a short or unlabelled secret, a host or URL. Each part is an interval; the parts of a
text are joined by interval with the parts of complementary roles in the same scope, at any distance. A scope is lines
without an empty one between them, or a section: from a header ([name], or a line that opens a brace) on, empty lines
before labelled lines don't end it. Within one line more than reach code points without any label end it, so that a long
line of prose is not one scope. A weak secret is reported if an identifier is there, a weak identifier
if a secret is there, an endpoint if both are there. Strong spans count as parts: access as an identifier, assign and
hex as secrets. The join is a sweep over intervals sorted by place, never over pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 400
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")

# Strong patterns, as the contract has them.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

# Weak parts.
_SAYS = r"""["']?[\x20\t]*[:=][\x20\t]*["']?"""
WEAK_IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?ai:user(?:_?name)?|login|client_?id|access_?key_?id|account(?:_?id)?|uid){_SAYS}([A-Za-z0-9][A-Za-z0-9._@+-]{{2,}})")
WEAK_SECRET = re.compile(rf"(?<![A-Za-z0-9])(?ai:password|passwd|pass|pwd|secret|token|api_?key|secret_?access_?key|private_?key|auth|credential|signature){_SAYS}([A-Za-z0-9+/_.=~!@#$%^&*-]{{6,}})")
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(rf"""[A-Za-z][A-Za-z0-9+.-]{{1,20}}://[^\s"'<>]+|(?<![A-Za-z0-9])(?ai:host(?:_?name)?|endpoint|server|url|dsn|database){_SAYS}([A-Za-z0-9][A-Za-z0-9._:/-]{{2,}})""")
NOT_SPACE = re.compile(r"\S")
EMPTY_LINE = re.compile(r"\n[\x20\t\r]*(?=\n)")
LABEL = re.compile(r"""["']?(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=]""")
HEADER = re.compile(r"""(?m:^)[\x20\t]*(?:\[{1,2}[A-Za-z0-9_\x20.:/"-]+\]{1,2}|[^\n]*\{)[\x20\t\r]*(?m:$)""")
LABELLED_LINE = re.compile(r"""\s*\n[\x20\t]*(?:export[\x20\t]+|-[\x20\t]+|[#;][^\n]*\n[\x20\t]*)*["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=]""")

ROLE = {"access": "identifier", "identifier": "identifier", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}
Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each strong pattern; those that are too short are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def ends_of_scopes(text: str, parts: list[Span], reach: int) -> list[int]:
    """Where in the text, in order, one scope ends and the next begins."""
    out, headers, last = [], [m.start() for m in HEADER.finditer(text)], 0
    run, labelled = 0, False  # where the white space that was looked at ends, and whether a labelled line follows it
    for m in EMPTY_LINE.finditer(text):
        headed = bisect_left(headers, last) < bisect_left(headers, m.start())
        if headed and m.start() >= run:
            # All empty lines of a run are followed by the same line: it is looked at once.
            labelled = LABELLED_LINE.match(text, m.start()) is not None
            run = after.start() if (after := NOT_SPACE.search(text, m.start())) else len(text)
        if not (headed and labelled):
            out.append(m.start())
            last = m.start()
    # Lines in which parts stand far apart.
    places = sorted(s[1:] for s in parts)
    for (_, b), (a, _) in zip(places, places[1:]):
        if a - b > reach and text.find("\n", b, a) < 0:
            at = b
            for begin, end in [*(m.span() for m in LABEL.finditer(text, b, a)), (a, a)]:
                if begin - at > reach:
                    out.append(begin)
                at = end
    return sorted(out)


def linked(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """The weak candidates whose complementary parts are in the same scope."""
    says = "=" in text or ":" in text
    identifiers = [("identifier", *m.span()) for m in WEAK_IDENTIFIER.finditer(text)] if says else []
    if not identifiers and not any(k == "access" for k, _, _ in base):
        return []
    weak = list(identifiers)
    if says:
        weak += [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text)]
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    weak += [("weak_secret", *m.span()) for m in BARE_SECRET.finditer(text)]
    # Strong spans stay as they are: what overlaps one isn't a part of its own.
    taken = merged(base)
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    weak = [s for s in weak if (i := bisect_left(starts, s[2])) == 0 or ends[i - 1] <= s[1]]
    if not weak:
        return []
    breaks = ends_of_scopes(text, [*base, *weak], reach)
    by_role = {r: sorted(s[1:] for s in [*base, *weak] if ROLE[s[0]] == r) for r in ("identifier", "secret")}
    starts = {r: [a for a, _ in own] for r, own in by_role.items()}
    # With starts sorted, the greatest end so far tells whether any interval before reaches into the scope.
    furthest = {}
    for r, own in by_role.items():
        most, furthest[r] = 0, []
        for _, b in own:
            most = max(most, b)
            furthest[r].append(most)

    def there(role: str, a: int) -> bool:
        i = bisect_right(breaks, a)
        low = breaks[i - 1] if i else 0
        high = breaks[i] if i < len(breaks) else len(text)
        last = bisect_left(starts[role], high)
        return last > 0 and furthest[role][last - 1] > low

    needs = {"weak_secret": ("identifier",), "identifier": ("secret",), "endpoint": ("identifier", "secret")}
    return [s for s in weak if all(there(r, s[1]) for r in needs[s[0]])]


def merged(found: list[Span]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for _, a, b in sorted(found, key=lambda s: s[1:]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))))


def find(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    text = text or ""
    base = strong(text)
    return base, linked(text, base, reach)


SPANS = "array<struct<kind:string,start:int,end:int,strong:boolean>>"


def secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(doc, secrets): one row for each row of docs with its spans by start, in code points of the whole text, end exclusive.

    Null and empty texts have none. Repeated rows each give a row, null ids too. No rows give no rows. A text of any length
    is taken whole, in time by its length.
    """

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base, more = find(t, reach)
            own = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([{"kind": k, "start": a, "end": b, "strong": st} for k, a, b, st in own])
        return pd.Series(out, dtype=object)

    return docs.select(F.col(f"`{doc}`").alias(doc), scan(F.col(f"`{text}`")).alias("secrets"))


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    found = secrets(docs)
    base = F.filter("secrets", lambda s: s["strong"])
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of overlapping spans in the text replaced by mark; n_chars, if there, follows the text."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        def one(t):
            base, more = find(t)
            out, at = [], 0
            for a, b in merged(base + more):
                out += [t[at:a], mark]
                at = b
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", hide("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


