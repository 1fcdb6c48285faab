"""Secret scan with structural confirmation.

Candidates come from patterns over each whole text; a candidate counts as confirmed once its own structure has
been read. Base64 of either alphabet (wrapped, indented or with escaped line ends), hex in either case and PEM bodies are
decoded and must be a private key: a DER structure whose nested lengths tile it and whose fields are those of PKCS#1, PKCS#8
(plain or encrypted), SEC1, DSA or PKCS#12; an OpenSSH or OpenPGP private key; or PEM text with one. Public keys and certificates
are no secrets. A PEM body encrypted by its header lines must name its cipher and be whole blocks. A signed token
must have a JSON header that names an algorithm, a JSON payload and a signature as long as that algorithm's. Confirmed candidates
that no base kind names are reported as spans of their own kinds; the base kinds (assign, access, hex) are
always reported, with a mark where their structure was confirmed too.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pem", "key", "token", "hexkey")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: A line end, as it is or escaped (as in a JSON string), with indents.
_GAP = rb"[ \t]*+(?:\r?\n|\\+[nrt])[ \t]*+"
_HEX_RUN = re.compile(rb"[0-9a-fA-F]{16,}+(?:" + _GAP + rb"[0-9a-fA-F]++)*+")
_HEX_PART = re.compile(rb"[0-9a-fA-F]+|(" + _GAP + rb")")
#: Where hex of a key starts: a DER sequence whose first field is a version or a sequence, an OpenSSH key, PEM text.
_HEX_START = re.compile(rb"30(?=(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6}|84[0-9a-f]{8})(?:02010[013]|30))|6f70656e7373682d6b65792d7631(?=00)|2d2d2d2d2d424547494e20", re.IGNORECASE)
_PEM_BEGIN = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PEM_HEADER = re.compile(rb"(?:\s|\\+[nrt])*+[A-Za-z][A-Za-z0-9-]*: ?([^\r\n\\]*)")
_PEM_GAP = re.compile(rb"\\+[nrt]|\s+")
_DEK = re.compile(rb"DEK-Info: ?(?:AES-(?:128|192|256)-CBC,([0-9A-Fa-f]{32})|DES-(?:EDE3-)?CBC,([0-9A-Fa-f]{16}))")
_TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Where base64 of a DER sequence or of an OpenSSH key starts, or that of PEM text goes on (its BEGIN at each of the three
#: places that a byte can have), and what may follow.
_BASE64_START = re.compile(rb"(?<![A-Za-z0-9])(?:M[A-P](?=[A-Za-z0-9+/_-]{20})|b3BlbnNzaC1rZXktdjE)|LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
_BASE64_RUN = re.compile(rb"[A-Za-z0-9+/_-]++(?:" + _GAP + rb"[A-Za-z0-9+/_-]++)*+={0,2}")
_BASE64_PART = re.compile(rb"[A-Za-z0-9+/_-]+|(" + _GAP + rb")")
_ALPHABET = bytes.maketrans(b"-_", b"+/")
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Bytes of a signature by algorithm; RSA's are at least as long as a 512-bit modulus (fixed values).
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}

FINDING = "array<struct<kind:string,start:long,stop:long,confirmed:boolean>>"


def der_items(data: bytes, start: int = 0, stop: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop of the content) of the DER elements that tile data[start:stop]; None if none do."""
    at, stop, items = start, len(data) if stop is None else stop, []
    while at < stop:
        if at + 2 > stop:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > stop:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if tag & 0x1F == 0x1F or at + n > stop:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def der_tiles(data: bytes, start: int = 0, stop: int | None = None) -> bool:
    """Whether DER elements tile data, and those of every constructed element likewise, however deep."""
    open_spans = [(start, len(data) if stop is None else stop)]
    while open_spans:
        items = der_items(data, *open_spans.pop())
        if items is None:
            return False
        open_spans += [(a, b) for tag, a, b in items if tag & 0x20]
    return True


def der_size(head: bytes) -> int:
    """Bytes of the DER element that head begins with, 0 if it can't be read."""
    if len(head) < 2 or head[1] == 0x80 or head[1] > 0x84:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def is_der_key(data: bytes) -> bool:
    """One DER sequence with the fields of a private key."""
    if len(data) < 24 or data[0] != 0x30 or der_size(data) != len(data) or not der_tiles(data):
        return False
    (_, a, b), = der_items(data)
    items = der_items(data, a, b) or []
    tags = [t for t, _, _ in items]
    version = data[items[0][1] : items[0][2]] if items and items[0][0] == 0x02 else None
    if version is None:  # encrypted PKCS#8: what encrypts it, then the octets
        inner = der_items(data, *items[0][1:]) if tags == [0x30, 0x04] else None
        return bool(inner) and inner[0][0] == 0x06 and items[1][2] - items[1][1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1"):  # PKCS#8
        inner = der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 0x06 and items[2][2] > items[2][1]
    if tags[:2] == [0x02, 0x04] and version == b"\1":  # SEC1
        return items[1][2] - items[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    if version == b"\3" and tags[:2] == [0x02, 0x30]:  # PKCS#12
        inner = der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    # PKCS#1 (nine numbers, ten with other primes) and DSA (six)
    return version in (b"\0", b"\1") and set(tags[:9]) == {0x02} and (len(tags) in (6, 9) or (len(tags) == 10 and tags[9] == 0x30)) and all(e > s for _, s, e in items)


def openssh_stop(data: bytes, start: int = 0) -> int:
    """Where the OpenSSH key at start ends, 0 if there is none: cipher, key derivation, its options, number of keys, each
    public key, then the private part, all within the data."""
    if not data.startswith(b"openssh-key-v1\0", start):
        return 0
    at, keys, fields = start + 15, 0, 3
    while fields:
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields -= 1
        if not fields and not keys:
            keys = int.from_bytes(data[at : at + 4], "big")
            at, fields = at + 4, keys and keys + 1
    return at if keys and at <= len(data) else 0


def is_pgp_key(data: bytes) -> bool:
    """An OpenPGP packet of a secret key whose length lies within the data."""
    if len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, n = data[0] & 0x3F, data[1] if data[1] < 192 else (data[1] - 192 << 8) + data[2] + 192 if data[1] < 224 else int.from_bytes(data[2:6], "big") if data[1] == 255 else 0
        at = 2 if data[1] < 192 else 3 if data[1] < 224 else 6
    else:
        k = 1 << (data[0] & 3)
        tag, n, at = data[0] >> 2 & 0x0F, int.from_bytes(data[1 : 1 + k], "big") if k < 8 else 0, 1 + k
    return tag == 5 and 0 < n <= len(data) - at and data[at] in (3, 4, 5, 6)


def is_key(data: bytes) -> bool:
    """A private key in DER or OpenSSH form."""
    return is_der_key(data) or openssh_stop(data) > 0


def is_private_pem(body: bytes) -> bool:
    """Whether what stands between a private key's BEGIN and END lines is one: header lines, then base64."""
    at, headers = 0, []
    while m := _PEM_HEADER.match(body, at):
        headers.append(m[0])
        at = m.end()
    text = _PEM_GAP.sub(b"", body[at:])
    if len(text) > 5 and text[-5:-4] == b"=" and not text.endswith(b"="):  # OpenPGP's checksum
        return bool(data := decoded(text[:-5])) and is_pgp_key(data)
    data = decoded(text)
    if not data:
        return False
    if any(b"ENCRYPTED" in h for h in headers):
        cipher = _DEK.search(b"\n".join(headers))
        return bool(cipher) and len(data) >= 32 and len(data) % (16 if cipher[1] else 8) == 0
    return is_key(data) or is_pgp_key(data)


def pem_stop(raw: bytes, m: re.Match) -> int:
    """Where the private key in PEM form ends whose BEGIN line is m, 0 if it is none."""
    end = raw.find(b"-----", m.end())
    mark = b"-----END " + m[1] + b"-----"
    return end + len(mark) if end >= 0 and raw.startswith(mark, end) and is_private_pem(raw[m.end() : end]) else 0


def pem_spans(raw: bytes) -> list[tuple[int, int]]:
    """(start, stop) of the private keys in PEM form; each text is read once."""
    return [(m.start(), stop) for m in _PEM_BEGIN.finditer(raw) if (stop := pem_stop(raw, m))]


def holds_key(data: bytes) -> bool:
    """A private key, or PEM text with one."""
    return is_key(data) or (b"-----BEGIN " in data and bool(pem_spans(data)))


def decoded(run: bytes) -> bytes | None:
    """Base64 of either alphabet, padded or not; None where it isn't."""
    body = run.rstrip(b"=").translate(_ALPHABET)
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Joined:
    """A run over several lines as one, with the places of its letters in the text."""

    def __init__(self, run: re.Match, part: re.Pattern):
        self.stop, self.letters, self.raws, own = run.end(), [], [], []
        length = 0
        for m in part.finditer(run[0]):
            if m[1] is None:
                self.letters.append(length)
                self.raws.append(run.start() + m.start())
                own.append(m[0])
                length += len(m[0])
        self.text = b"".join(own)

    def letter(self, raw: int) -> int:
        """The letter at a place of the text."""
        i = bisect.bisect_right(self.raws, raw) - 1
        return self.letters[i] + raw - self.raws[i]

    def place(self, letter: int) -> int:
        """The place in the text of a letter."""
        i = bisect.bisect_right(self.letters, letter) - 1
        return self.raws[i] + letter - self.letters[i]


def base64_spans(raw: bytes) -> list[tuple[int, int]]:
    """(start, stop) of keys in base64. A DER key's own length says where it stops, whatever it is; a run is joined once."""
    found, at, run = [], 0, None
    for m in _BASE64_START.finditer(raw):
        if m.start() < at:
            continue
        start = m.start()
        if m[0].startswith(b"M"):
            head = decoded(raw[m.start() : m.start() + 12])
            size = der_size(head) if head else 0
            # the first field is a number or a sequence
            if not head or size < 24 or head[min(size, 2 + (head[1] & 0x7F if head[1] & 0x80 else 0))] not in (0x02, 0x30):
                continue
            if run is None or start >= run.stop:
                run = Joined(_BASE64_RUN.match(raw, start), _BASE64_PART)
            first, chars = run.letter(start), -(-size * 4 // 3)
            data = decoded(run.text[first : first + chars]) if first + chars <= len(run.text) else None
            if not data or not is_der_key(data[:size]):
                continue
            stop = run.place(first + chars - 1) + 1
            stop += len(re.match(rb"={0,2}", raw[stop : stop + 2])[0])
        else:
            if not m[0].startswith(b"b3"):
                start = at + len(raw[at:start].rstrip(_LETTERS))
            whole = _BASE64_RUN.match(raw, start)
            data = decoded(_PEM_GAP.sub(b"", whole[0]))
            stop = at = whole.end()
            if not data or not holds_key(data):
                continue
        found.append((start, stop))
        at = stop
    return found


def hex_spans(raw: bytes) -> list[tuple[int, int]]:
    """(start, stop) of keys in hex of either case, over lines or not. Whatever digits stand before or after, a key starts
    where its structure does and its own lengths say where it stops."""
    found = []
    for m in _HEX_RUN.finditer(raw):
        run, at, halves = None, 0, {}
        if m.end() - m.start() < 48:
            continue
        run = Joined(m, _HEX_PART)
        for s in _HEX_START.finditer(run.text):
            first = s.start()
            if first < at:
                continue
            odd = first % 2
            if odd not in halves:  # the run from its first or second digit
                halves[odd] = binascii.unhexlify(run.text[odd : odd + (len(run.text) - odd) // 2 * 2])
            data, own = halves[odd], (first - odd) // 2
            if data[own] == 0x30:
                stop = own + der_size(data[own : own + 6])
                stop = stop if own + 24 <= stop <= len(data) and is_der_key(data[own:stop]) else 0
            elif data[own] == 0x6F:
                stop = openssh_stop(data, own)
            else:
                begin = _PEM_BEGIN.match(data, own)
                stop = pem_stop(data, begin) if begin else 0
            if stop:
                at = odd + 2 * stop
                found.append((run.place(first), run.place(at - 1) + 1))
    return found


def is_token(run: bytes) -> bool:
    """A signed token: a JSON header that names an algorithm, a JSON payload, and a signature of that
    algorithm's length (others: 16 bytes or more)."""
    head, payload, signature = (decoded(x) for x in run.split(b".", 2))
    try:
        found, said = json.loads(head or b""), json.loads(payload or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(found, dict) or not isinstance(said, dict) or not isinstance(found.get("alg"), str) or not signature:
        return False
    want = _SIGNATURES.get(found["alg"])
    if found["alg"] == "EdDSA":
        return len(signature) in (64, 114)
    return len(signature) == want if want else len(signature) >= (64 if found["alg"][:2] in ("RS", "PS") else 16)


def has_structure(run: bytes) -> bool:
    """Whether what is assigned to a name is a signed token, has a key in hex or is one in base64."""
    if run.startswith(b"eyJ") and run.count(b".") >= 2:
        return is_token(run)
    if hex_spans(run):
        return True
    return len(run) >= 40 and (data := decoded(run)) is not None and holds_key(data)


def scan(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, confirmed) of a text, by start, then kind; code points, stop exclusive."""
    raw = text.encode("utf-8")
    low = raw.lower()  # ASCII letters alone
    found: list[tuple[int, int, int, bool]] = []
    if any(n in low for n in _NAMES):
        for m in _ASSIGN.finditer(low):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), 0, m.end(), has_structure(raw[m.start(2) : m.end(2)])))
    if b"AKIA" in raw:
        for m in _ACCESS.finditer(raw):
            if m.end() - m.start() >= 20:
                found.append((m.start(), 1, m.end(), m.end() - m.start() == 20 and not re.search(rb"[0189]", m[0][4:])))
    plain = [m.span() for m in _HEX.finditer(raw)]
    keys = hex_spans(raw)
    starts = [s for s, _ in plain]
    sure = set()
    for s, e in keys:  # a key within a base span confirms it, others are spans of their own
        i = bisect.bisect_right(starts, s) - 1
        if i >= 0 and e <= plain[i][1]:
            sure.add(i)
        else:
            found.append((s, 6, e, True))
    found += [(s, 2, e, i in sure) for i, (s, e) in enumerate(plain)]
    if b"-----BEGIN " in raw:
        found += [(s, 3, e, True) for s, e in pem_spans(raw)]
    inside = [(s, e) for s, k, e, _ in found if k == 3]
    for s, e in base64_spans(raw):
        i = bisect.bisect_right(inside, (s, len(raw))) - 1
        if i < 0 or s >= inside[i][1]:
            found.append((s, 4, e, True))
    if b"eyJ" in raw:
        for m in _TOKEN.finditer(raw):
            if is_token(m[0]):
                found.append((m.start(), 5, m.end(), True))
    found.sort()
    if found and len(raw) != len(text):
        marks = sorted({x for s, _, e, _ in found for x in (s, e)})
        at, points, last = {}, 0, 0
        for x in marks:
            points += len(raw[last:x].decode("utf-8"))
            at[x], last = points, x
        found = [(at[s], k, at[e], c) for s, k, e, c in found]
    return [(KINDS[k], s, e, c) for s, k, e, c in found]


def findings(text: Column) -> Column:
    """The findings of a text column as an array; a null or empty text has none."""

    @F.arrow_udf(FINDING)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "stop": e, "confirmed": c} for k, s, e, c in scan(t)] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("confirmed", pa.bool_())])))

    return scanned(text)


def masked(text: str) -> str:
    """The text with every finding replaced by a mark of its kind; overlapping ones become one mark."""
    spans: list[list] = []
    for kind, s, e, _ in scan(text):
        if spans and s < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e, kind])
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all secrets masked in the text column; a null text stays null, all rows and other
    columns stay as they are."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([t and masked(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings of every row. Repeated rows and null ids are kept, extra columns ignored; a
    null text is empty; an empty table gives no row."""
    return docs.select(F.col(id_col).alias("doc_id"), findings(text_of(text_col)).alias("findings"))


def op2_structural_secret_scan(spark, sf_dir: str) -> DataFrame:
    kind = lambda k: F.filter("findings", lambda x: x["kind"] == k)
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *(F.size(kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
    )
