"""Secret scans: all rules run as one automaton in one pass over the bytes of a text.

The pass marks where rules can end. From each end the rule's mirrored automaton reads back to the
leftmost start after the rule's previous match; the rule's own condition then decides. Of the kinds beyond the base ones the
automaton holds what they start with.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import text_bytes

# Kind, expression, whether letters count in either case, group measured, least length of it.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = [
    ("assign", ASSIGN, True, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    ("hex", r"[0-9a-f]{32,}", False, 0, 32),
]
_KEY_LINE = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"
MORE_RULES = [
    ("age", r"AGE-SECRET-KEY-1[A-Z0-9]+", False, 0, 60),
    ("aws_secret", r"""aws_?secret(_?access)?_?key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/=]+)""", True, 2, 40),
    ("azure", r"AccountKey=[A-Za-z0-9+/=]+", False, 0, 60),
    ("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", True, 0, 27),
    ("github", r"gh[opsur]_[A-Za-z0-9]+", False, 0, 40),
    ("github_fine", r"github_pat_[A-Za-z0-9_]+", False, 0, 40),
    ("gitlab", r"glpat-[A-Za-z0-9_-]+", False, 0, 26),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("google_oauth", r"ya29\.[A-Za-z0-9_-]+", False, 0, 30),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
    ("model_key", r"sk-(proj-|ant-|svcacct-)[A-Za-z0-9_-]+", False, 0, 40),
    ("model_key_old", r"sk-[A-Za-z0-9]+", False, 0, 35),
    ("npm", r"npm_[A-Za-z0-9]+", False, 0, 40),
    ("pem", _KEY_LINE, False, 0, 27),
    ("pem_end", _KEY_LINE.replace("BEGIN", "END"), False, 0, 25),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 60),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("slack_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+", False, 0, 60),
    ("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", False, 0, 24),
    ("url_password", r"""(https?|ftp|postgres(ql)?|mysql|mongodb(\+srv)?|rediss?|amqps?)://[^\x00-\x20"':@/]+:[^\x00-\x20"':@/]+@""", False, 0, 10),
]
#: What a kind of our own starts with. The automaton finds these; what follows is read on from there, so that no
#: product of all rules' bodies is ever built. Such kinds start after a
#: character of no word, but for the lines of private keys, which may follow a written-out line end.
HEADS = {
    "age": "AGE-SECRET-KEY-1", "aws_secret": "aws_?secret(_?access)?_?key", "azure": "AccountKey=", "bearer": r"bearer\x20", "github": "gh[opsur]_",
    "github_fine": "github_pat_", "gitlab": "glpat-", "google": "AIza", "google_oauth": r"ya29\.", "jwt": "eyJ", "model_key": "sk-(proj-|ant-|svcacct-)",
    "model_key_old": "sk-[A-Za-z0-9]", "npm": "npm_", "pem": "-----BEGIN ", "pem_end": "-----END ", "sendgrid": r"SG\.", "slack": "xox[abprs]-",
    "slack_hook": "https://hooks", "stripe": "[rs]k_(live|test)_", "url_password": r"(https?|ftp|postgres(ql)?|mysql|mongodb(\+srv)?|rediss?|amqps?)://",
}
RULES = BASE_RULES + MORE_RULES
_JWT = [r[0] for r in RULES].index("jwt")
#: What a token's first part is made of: all heads within one run of it are followed by the same, so that where one fails all do.
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]*")
_PEM, _PEM_END = ([r[0] for r in RULES].index(k) for k in ("pem", "pem_end"))
#: What may follow the first line of a private key whose last line is missing.
_KEY_BODY = re.compile(rb"[A-Za-z0-9+/=\r\n\\]*")


#: In the automaton hex digits count from four on; the rule's own condition decides on their number.
_SHORT_HEX = "[0-9a-f]{4,}"
_WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


@cache
def _compiled():
    rules = [(_SHORT_HEX if kind == "hex" else p, fold) for kind, p, fold, _, _ in BASE_RULES]
    rules += [(HEADS[kind], fold) for kind, _, fold, _, _ in MORE_RULES]
    forward = Automaton(rules)
    back = [Automaton([rule], anchored=True, backwards=True) for rule in rules]
    whole = [re.compile(p.encode(), re.IGNORECASE if fold else 0) for _, p, fold, _, _ in RULES]
    return forward, back, whole


def _ends(data: bytes, auto: Automaton) -> dict[int, list[int]]:
    """For each rule, the ends of its runs of accepting positions."""
    table, first, accepts = auto.table, auto.first_accepting, auto.accepts
    ends: dict[int, list[int]] = {}
    state, at = 0, 0
    for c in data.translate(auto.translate):
        state = table[state][c]
        at += 1
        if state >= first:
            bits, k = accepts[state], 0
            while bits:
                if bits & 1:
                    own = ends.setdefault(k, [])
                    if own and own[-1] == at - 1:
                        own[-1] = at
                    else:
                        own.append(at)
                bits >>= 1
                k += 1
    return ends


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """Matches ``(start, end, rule)`` in bytes: for each rule leftmost, not overlapping, as long as can be."""
    forward, back, whole = _compiled()
    found = []
    for k, ends in _ends(data, forward).items():
        auto, last, failed, (_, _, _, group, least) = back[k], 0, 0, RULES[k]
        for end in ends:
            state, start, at = 0, -1, end
            while at > last:
                at -= 1
                state = auto.table[state][auto.classes[data[at]]]
                if state == auto.dead:
                    break
                if state >= auto.first_accepting:
                    start = at
            if start < 0:
                continue
            if k < len(BASE_RULES):
                last = end  # a match that fails its condition has still taken its text
                m = whole[k].fullmatch(data, start, end)
            else:
                alone = k in (_PEM, _PEM_END) or not start or data[start - 1] not in _WORD
                m = whole[k].match(data, start) if alone and start >= failed else None
                if k == _JWT and m is None and start >= failed:
                    failed = _JWT_RUN.match(data, start).end()
                last = m.end() if m else last
            if m and len(m[group]) >= least:
                found.append((*m.span(), k))
    return sorted(_whole_keys(data, found), key=lambda x: (x[0], x[2]))


def _whole_keys(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Private keys as one match each, from the first line through the last one, or as far as a key's text goes where the last one is missing."""
    lines = sorted(x for x in found if x[2] in (_PEM, _PEM_END))
    if not lines:
        return found
    keys = []
    for (start, end, k), (_, close, then) in zip(lines, [*lines[1:], (len(data), 0, -1)]):
        if k == _PEM:
            keys.append((start, close if then == _PEM_END else _KEY_BODY.match(data, end).end(), k))
    return [x for x in found if x[2] not in (_PEM, _PEM_END)] + keys


def spans_of(data: bytes) -> list[tuple[int, int, int]]:
    """``scan`` in code points."""
    found = scan(data)
    if not found or data.isascii():
        return found
    at, points, where = 0, 0, {}
    for p in sorted({p for s, e, _ in found for p in (s, e)}):
        points += len(data[at:p].decode("utf-8"))
        at, where[p] = p, points
    return [(where[s], where[e], k) for s, e, k in found]


def _written(spans) -> str:
    return ",".join(f"{RULES[k][0]}:{s}:{e}" for s, e, k in spans)


def _scan(batches):
    for batch in batches:
        rows = []
        for data in text_bytes(batch.column(1)):
            spans = spans_of(data)
            base = [x for x in spans if x[2] < len(BASE_RULES)]
            n = [sum(1 for x in base if x[2] == k) for k in range(len(BASE_RULES))]
            rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row of ``docs(doc_id, text, ...)``.

    ``spans`` lists ``kind:start:end`` in code points by start, then kind; ``base_sha256`` is the
    SHA-256 of those of the three base kinds. Null and empty texts have no spans (the hash is that
    of the empty string); doc_id is passed on, null or repeated; no rows give none; other columns
    are ignored. A rule's failing match still takes its text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(data: bytes) -> bytes:
    """The text with each stretch that spans cover replaced by ``[SECRET]``."""
    out, at = [], 0
    end_of = -1
    for s, e, _ in scan(data):
        if s >= end_of:
            out += [data[at:s], b"[SECRET]"]
        end_of = max(end_of, e)
        at = end_of
    return b"".join([*out, data[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars``, where there, follows. Null texts stay null."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [None if x is None else masked(x).decode("utf-8") for x in batch.column(k).cast(pa.binary()).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
