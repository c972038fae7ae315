"""Template residue and error-page text: character n-gram models, likelihood-ratio windows, exclusion by coverage.

Three residue models (template fields, filler, notices of errors and scripts) are fitted on short seed texts, the
model of natural prose on every document of the corpus: its hashed 4-gram counts are added up inside each partition, so
that only one table of fixed size leaves it. All models are brought to the same effective size, so an n-gram that
neither side knows weighs nothing and the ratio behaves alike at every corpus size.

Each document is scored whole. Windows whose likelihood ratio exceeds a bound localise the residue. Template fields are
told by their words and, whatever their words, by their shape; the grammar of a field is looked for in the localised
stretches only. Filler is decided by the share of its sentences that a stretch covers, notices by the share of the content
that their sentences cover. What is quoted is talked about and does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number of hash buckets of the n-gram tables, and the smoothing count of each.
BUCKETS, ALPHA = 1 << 17, 0.02

#: Names of fields, marks that templates put around them, and blanks that forms leave.
_FIELDS = "company name|company_name|fiscalYear|filing_date|amount|first name|last name|ticker|net-sales|segment_1|period_end|auditor|issuer.legalName|address.city|CEO NAME|date|title|user.email|report-year|FIELD_9|customer|Invoice Number".split("|")
_SHAPES = "{{%}}|{{ % }}|{{ % | default }}|{%}|${%}|#{%}|{%%%}|{% % %}|{% if % %}|<%= % %>|@@%@@|%%%%%|__%__|<<%>>|[[%]]|<%>|&lt;%&gt;|[% TO COME]|[INSERT %]|[Enter % here]|[Your % here]|(insert %)|[insert %]|[add %]|(enter % here)".split("|")
_BLANKS = "[TBD by counsel]|[NTD: confirm with tax]|[Company]|[DATE]|[Year]|[Name]|[Title]|[Address]|[Client Name]|[Signatory]|Mr./Ms. [Last]|$X,XXX|XX.X%|XX/XX/20XX|________|[●], 20[●]|$[___]|%s|%d|{0} and {1}|<placeholder>|[TBD]|[to come]|[●]|XXX-XX-XXXX|[_____]|Dear [Customer]|Dear [Name]".split("|")
#: Pseudo-Latin that typesetters have long used to fill pages.
_LATIN = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea "
    "commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id "
    "est laborum. Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod "
    "gravida. Duis ac tellus et risus vulputate vehicula. Donec lobortis risus a elit. Etiam tempor. Ut ullamcorper, ligula eu tempor congue, eros est euismod turpis, id tincidunt sapien risus a quam. Maecenas fermentum "
    "consequat mi. Pellentesque malesuada nulla a mi. Duis sapien sem, aliquet nec, commodo eget, consequat quis, neque. Aliquam faucibus, elit ut dictum aliquet, felis nisl adipiscing sapien, sed malesuada diam lacus eget "
    "erat. Cras mollis scelerisque nunc. Nullam arcu. Aliquam consequat. Curabitur augue lorem, dapibus quis, laoreet et, pretium ac, nisi. Aenean magna nisl, mollis quis, molestie eu, feugiat in, orci. In hac habitasse "
    "platea dictumst. Fusce convallis, mauris imperdiet gravida bibendum, nisl turpis suscipit mauris, sed placerat ipsum urna sed risus. In convallis tellus a mauris. Curabitur non elit ut libero tristique sodales. Mauris a "
    "lacus. Donec mattis semper leo. In hac habitasse platea dictumst. Vivamus facilisis diam at odio. Mauris dictum, nisi eget consequat elementum, lacus ligula molestie metus, non feugiat orci magna ac sem. Donec turpis. "
    "Donec vitae metus. Morbi tristique neque eu mauris. Quisque gravida ipsum non sapien. Proin turpis lacus, scelerisque vitae, elementum at, lobortis ac, quam. Aliquam dictum eleifend risus. Praesent ac sem eget est "
    "egestas volutpat. Vivamus consectetuer hendrerit lacus. Cras non dolor. Vivamus in erat ut urna cursus viverra justo. Porta lectus sagittis augue ornare velit semper vitae libero neque."
)


def _product(*parts: str) -> list[str]:
    """Every phrase made of one alternative (separated by bars) of each part."""
    return [" ".join(x).strip() for x in product(*(p.split("|") for p in parts))]


def seeds() -> dict[str, list[str]]:
    """The texts that the residue models are fitted on."""
    template = [f" {_fill(s, f)} " for s in _SHAPES for f in [*_FIELDS, *(x.upper() for x in _FIELDS[:8])]]
    template += [f"{a}{b}{c}" for b in _BLANKS for a in (" ", " $", "of ", "by ", "to ", "is ", "um ", "le ", "de ") for c in (" ", ".", ", ", "; ", ": ", " million ")]
    filler = [x.strip() + "." for x in _LATIN.split(".") if x.strip()]
    words = _LATIN.lower().replace(",", "").replace(".", "").split()
    rng = np.random.default_rng(3)
    filler += [" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(90)]
    filler += _product("Dummy|Filler|Mock|Sample|Stand-in|Draft|Placeholder", "text|copy|wording|paragraph|content", "for section 1.|for layout box 12|pending for note 4...|to be replaced in part 8.|goes here|, replace before filing.|only.")
    filler += _product("Insert|Add|Type|Enter|Put|Write|Replace|Paste|Edit", "your|some|this|the", "text|content|copy|title|heading|caption|description", "here.|in this area.|to be supplied.|later.")
    filler += _product("Text|Content|Heading|Title|Body copy|Caption|Description|Narrative|Details", "goes here.|to be supplied.|coming soon.|to follow.|will be added here.|to be added.|pending.")
    filler += _product("This is|Here is|This paragraph is|This block is", "dummy|placeholder|filler|sample|example", "text.|copy.|content.")
    filler += 6 * "Placeholder for discussion.|Your caption here.|Your text here|Click to add text.|Click here to edit.|Double click to edit this text.|xxx xxx xxx|blah blah blah|asdf asdf qwerty|qwerty qwerty|test test test|TBD. TBD. TBD.|TBC. TBC.|foo bar baz|n/a n/a n/a|Hier Text einfügen.|Platzhaltertext.|Beispieltext.|Überschrift einfügen.|Insérer le texte ici.|Texte d'exemple.|Titre à compléter.|Insertar texto aquí.|Texto de ejemplo.|Título por definir.".split("|")
    notice = _product("To read this filing,|Please|You must|Kindly|To continue,|In order to see the tables,|You need to", "enable|activate|turn on|switch on|allow", "JavaScript|JS|scripts|scripting|cookies", "in your browser.|and reload.|, then refresh!|for this archive.")
    notice += _product("page|filing|document|report|exhibit|link|resource|file", "could not be found.|is no longer here.|cannot be shown to you.|does not exist on this server (code 404).|failed to load.|was moved or removed.|is not available right now.|has expired.|is restricted.")
    notice += [f"{a} {x}" for x in notice[-72:] for a in ("The", "This", "Sorry, that", "Requested")]
    notice += _product("You do not have|You lack|Your account does not have", "permission|access|authorization|the rights", "to view|to open|to see", "this page.|this file.|the requested resource.")
    notice += _product("JavaScript is|Scripts are|Cookies are|JavaScript has been", "disabled|turned off|blocked|not supported|required", "in your browser.|by your settings.|on this page.|for this site.")
    notice += 12 * (
        "Error 404|HTTP Error 500: the server could not complete the request|404 - the page you asked for was not found|403 Forbidden|401 Unauthorized|Access denied.|Permission denied.|Bad gateway|502 Bad Gateway|Service temporarily unavailable|Status: 404|"
        "Gateway timed out while waiting for the upstream|504 Gateway Timeout|Internal server error|Internal server failure (code 500)|Your session has expired; sign in again to continue|Your session timed out. Please log in again.|Too many requests from your address.|Sorry, this page is gone.|"
        "Warning: database connection refused in index.php on line 12|Fatal error: Uncaught exception in file.php on line 3|Traceback (most recent call last): KeyError: 'name'|java.lang.NullPointerException at Main.run(Main.java:88)|Try again later.|Please try again later.|Return to the home page.|Slow down and retry.|Oops! Something went wrong on our end.|"
        "This site is down for maintenance until further notice.|We will be back shortly.|Document unavailable: retention period elapsed, object deleted.|We could not find what you were looking for.|An unexpected error occurred.|The request could not be processed.|The server returned an error.|"
        "Turn it on and reload the page.|If nothing appears, check that scripts are allowed.|Checking your browser before opening the document.|Verify that you are human.|Complete the captcha to continue.|"
        "You need to enable JavaScript to run this app.|Your browser does not support the features required.|Your browser is out of date; please upgrade.|Please enable JavaScript to view this page.|Please log in to continue.|This content requires scripts.|"
        "For full functionality of this site it is necessary to enable JavaScript.|<noscript>This page requires client-side code.</noscript>|Reference no. 0.|"
        "Veuillez activer JavaScript pour afficher ce document.|Cette page exige des scripts actifs.|Accès refusé à ce document.|Erreur 404 : page introuvable|Service momentanément indisponible|Veuillez réessayer plus tard.|Votre session a expiré.|"
        "Diese Seite benötigt Skripte.|Bitte aktivieren Sie JavaScript, um den Bericht zu sehen.|Dienst zurzeit nicht verfügbar|Zugriff verweigert.|Fehler 404: Seite nicht gefunden|Bitte melden Sie sich an.|Bitte versuchen Sie es später erneut.|"
        "Active JavaScript para ver este informe.|Esta página requiere scripts habilitados.|Error 404: página no encontrada|Servicio no disponible por ahora|Acceso denegado.|Vuelva a intentarlo más tarde.|Su sesión ha caducado."
    ).split("|")
    shape = [f" {_fill(s, f)} " for s in _SHAPES[:18] for f in _FIELDS] + [f"{a}{b}{c}" for b in _BLANKS for a in (" ", "of ", "by ") for c in (" ", ".", ", ")]
    return {"template": template, "shape": shape, "filler": filler, "notice": notice}


def _fill(shape: str, field: str) -> str:
    """``shape`` with ``field`` in place of its one mark, whatever percent signs belong to the shape itself."""
    marks = {"{%%%}": "{%¤%}", "{% % %}": "{% ¤ %}", "{% if % %}": "{% if ¤ %}", "<%= % %>": "<%= ¤ %>", "%%%%%": "%%¤%%"}
    return marks.get(shape, shape.replace("%", "¤")).replace("¤", field)


def _flat(texts: pa.Array) -> pa.Array:
    """Texts with single blanks or line feeds between words and every number written 0; case is kept."""
    x = pc.fill_null(texts.cast(pa.large_string()), "")
    x = pc.replace_substring_regex(pc.replace_substring_regex(x, r"[\s\x{a0}]*[\r\n][\s\x{a0}]*", "\n"), r"[ \t\x0b\f\x{a0}]+", " ")
    return pc.replace_substring_regex(x, r"[0-9]+(?:[.,][0-9]+)*", "0")


#: Byte to byte: what the n-grams of words see (lower case, line feeds as blanks) and what those of shapes see (letters as letters).
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[10] = 32
_SHAPE = _PLAIN.copy()
_SHAPE[97:123], _SHAPE[65:91] = ord("a"), ord("A")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts)."""
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offs, body = texts.buffers()
    bounds = np.frombuffer(offs, np.int64, len(texts) + 1)
    return (np.frombuffer(body, np.uint8, int(bounds[-1])) if body is not None else np.zeros(0, np.uint8)), bounds


def _grams(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bucket of the 4-gram at each byte, seen through ``table``."""
    b = np.concatenate((table[data], np.zeros(3, np.uint8))).astype(np.uint64)
    n = len(data)
    h = (b[:n] + (b[1 : n + 1] << np.uint64(8)) + (b[2 : n + 2] << np.uint64(16)) + (b[3 : n + 3] << np.uint64(24))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(47)).astype(np.int64)


#: Bytes of text that are scored at a time; a longer text is scored alone, whole.
SLICE_BYTES = 2_000_000


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about :data:`SLICE_BYTES` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def natural_counts(documents: DataFrame, text: str) -> np.ndarray:
    """Hashed 4-gram counts of words and shapes over all documents; a table of fixed size per partition is all that moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in (x for b in batches for x in _slices(b, 0)):
            data, _ = _bytes(_flat(batch.column(0)))
            total[:BUCKETS] += np.bincount(_grams(data, _PLAIN), minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(_grams(data, _SHAPE), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["g", "n"])

    rows = documents.select(text).mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * BUCKETS)
    out[rows["g"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(2, BUCKETS)


def ratio_tables(natural: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood ratio of every bucket for each residue model against natural prose."""
    out = {}
    for kind, texts in seeds().items():
        data, bounds = _bytes(_flat(pa.array(texts, pa.large_string())))
        grams = _grams(data, _SHAPE if kind == "shape" else _PLAIN)
        cut = np.concatenate([np.arange(a, max(a, b - 3)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        own = np.bincount(grams[cut], minlength=BUCKETS).astype(np.float64)
        size = own.sum()
        prose = natural[1 if kind == "shape" else 0]
        other = prose / max(1.0, prose.sum()) * size
        out[kind] = np.log((own + ALPHA) / (other + ALPHA)).astype(np.float32)
    return out


_TAGS = r"(?!/?(?:html|head|body|p|b|i|u|h\d|br|div|span|a|ul|ol|li|table|tr|td|th|noscript|script|em|strong|sup|sub|img|font|hr|title|style)\b)"
#: Bracketed words that stand in finished texts.
_PRINTED = r"(?!(?:reserved|emphasis|sic|signature|remainder|omitted|redacted|continued|table)\b)"
#: What an unfilled field looks like; it only confirms a stretch that the models found.
FIELD = re.compile(
    rf"\{{\{{[^{{}}\n]{{1,80}}\}}\}}|[$#]\{{[^{{}}\n]{{1,60}}\}}|\{{%[^%\n]{{1,60}}%\}}|<%[^%\n]{{1,60}}%>|@@[^@\n]{{1,60}}@@|%%[^%\n]{{1,60}}%%|__[a-z][\w .-]{{0,40}}?__|<<[^<>\n]{{1,60}}>>|\[\[[^\[\]\n]{{1,60}}\]\]|"
    rf"\{{[a-z_][\w.-]*(?: [\w.-]+){{0,2}}\}}|\{{0\}}|<{_TAGS}[a-z][\w .-]{{0,40}}>|&lt;{_TAGS}[a-z][\w .-]{{0,40}}&gt;|\[[^\]\n]{{1,40}} to come\]|\[(?:insert|enter|add|tbd|ntd|your)\b[^\]\n]{{0,40}}\]|\((?:insert|enter|add|your) [^)\n]{{1,40}}\)|"
    rf"\[{_PRINTED}(?-i:[A-Z])[\w'/-]*(?: [\w'/-]+){{0,2}}\]|\[(?:date|year|name|amount|title|address|number|company|to come|_{{2,}}|●)\]|_{{5,}}|"
    r"\$X{1,3},X{3}|\bX{2,3}\.X{1,2}%|\bX{2}/X{2}/(?:0|20)?X{2,4}\b|\bX{3}-X{2}-X{4}\b|(?<![\w%])%[sd](?!\w)",
    re.I,
)

#: Window lengths in bytes and the mean ratio per byte from which a window counts.
WINDOWS = {"template": (8, 0.08), "shape": (8, 0.3), "filler": (16, 0.35), "notice": (14, 0.5)}
#: Share of the content that notices must cover, and share of its sentences that a stretch of filler must cover.
COVERAGE, SENTENCE = 0.5, 0.7
#: Least length in bytes of a stretch of filler, and how far beyond it the ends of its sentences are looked for.
STRETCH, REACH = 12, 400
#: A line of at most so many letters that does not end like a sentence is a heading.
HEADING = 80
_ENDS = re.compile(rb"[.!?]+(?=\s|$)|\n")
_PIECE = re.compile(r"[^.!?\n]*(?:[.!?](?!\s|$)[^.!?\n]*)*(?:[.!?]+|\n|$)")
#: What is said between quotes.
_SAID = re.compile(rb"\"[^\"\n]{2,300}\"|`[^`\n]{2,300}`|\xe2\x80\x9c[^\n]{2,300}?\xe2\x80\x9d|\xc2\xab[^\n]{2,300}?\xc2\xbb")
_QUOTES = "\"'`“”‘’«»„"


def _runs(inside: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of ``inside``, none of which leaves its text."""
    turn = np.flatnonzero((inside[1:] != inside[:-1]) | (row[1:] != row[:-1])) + 1 if len(inside) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], turn))[: len(turn) + 1 if len(inside) else 0]
    ends = np.concatenate((turn, [len(inside)]))[: len(starts)]
    on = inside[starts]
    starts, ends = starts[on], ends[on]
    texts = row[starts]
    return list(zip(texts.tolist(), (starts - bounds[texts]).tolist(), (ends - bounds[texts]).tolist(), strict=True))


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between quotes: it is talked about."""
    return a > 0 and b < len(text) and text[a - 1] in _QUOTES and text[b] in _QUOTES


def _field_in(raw: bytes, a: int, b: int) -> bool:
    """Whether an unfilled field that is not merely quoted touches bytes a to b of a text."""
    lead = raw[max(0, a - 60) : a].decode(errors="ignore")
    text = lead + raw[a : b + 60].decode(errors="ignore")
    end = len(lead) + len(raw[a:b].decode(errors="ignore"))
    return any(x.end() > len(lead) and x.start() < end and not _quoted(text, *x.span()) for x in FIELD.finditer(text))


def _filler_in(raw: bytes, a: int, b: int, inside: np.ndarray) -> bool:
    """Whether stretches like bytes a to b (``inside``) fill most of the sentences that this one stands in; quotes do not count."""
    begins = [x.end() for x in _ENDS.finditer(raw, max(0, a - REACH), a)]
    stop = _ENDS.search(raw, max(a, b - 2), b + REACH)
    first, last = begins[-1] if begins else max(0, a - REACH), stop.start() if stop else min(len(raw), b + REACH)
    last = max(last, b)
    free = np.ones(last - first, bool)
    for x in _SAID.finditer(raw, first, last):
        free[x.start() - first : x.end() - first] = False
    hit = inside[first:last] & free
    return hit.sum() >= max(STRETCH, SENTENCE * free.sum())


def _notice_share(raw: bytes, table: np.ndarray) -> float:
    """Share of the letters of a text in sentences that the notice model prefers.

    Lines without the end of a sentence (headings, navigation) count only if they are long or the model prefers them.
    """
    body = re.sub(r"<(?!/?noscript)[^>\n]{1,40}>", "\n", raw.decode(errors="ignore"))
    lines = [(x, bool(re.search(r"[.!?;:…]\W*$", x))) for x in map(str.strip, body.split("\n"))]
    split = [(p.strip(), ended or len(line) > HEADING) for line, ended in lines for p in (_PIECE.findall(line) if ended or len(line) > HEADING else [line]) if re.search(r"\w", p)]
    pieces, counted = [p for p, _ in split], [c for _, c in split]
    if not pieces:
        return 1.0 if "noscript" in body else 0.0
    data, bounds = _bytes(pa.array([f" {p} " for p in pieces], pa.large_string()))
    ratio = table[_grams(data, _PLAIN)]
    hit = all_ = 0
    for piece, count, a, b in zip(pieces, counted, bounds[:-1], bounds[1:], strict=True):
        noticed = b - a >= 6 and ratio[a : b - 3].mean() > WINDOWS["notice"][1]
        hit += len(piece) * noticed
        all_ += len(piece) * (noticed or count)
    return hit / max(1, all_)


def residue_cover(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, template, filler, notice): what share of each document the residue of each kind covers.

    Stretches are found by the models alone. ``template`` counts those in which a field is seen that is not merely quoted,
    ``filler`` those that fill most of their sentences; ``notice`` is the share of the content, see :func:`_notice_share`.

    Null and empty texts have zero shares. Repeated rows give one row each; other columns are ignored.
    """
    tables = documents.sparkSession.sparkContext.broadcast(ratio_tables(natural_counts(documents, text)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _slices(b, 1)):
            flat = _flat(batch.column(1))
            data, bounds = _bytes(flat)
            n, lengths = len(flat), np.diff(bounds)
            row = np.repeat(np.arange(n), lengths)
            start = np.arange(len(data))
            tail = (bounds[1:][row] - start) < 4  # n-grams that would reach into the next text
            grams = {True: _grams(data, _SHAPE), False: _grams(data, _PLAIN)}
            inside = {}
            for kind, (width, least) in WINDOWS.items():
                ratio = np.where(tail, 0, tables.value[kind][grams[kind == "shape"]])
                sums = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
                stop = np.minimum(start + width, bounds[1:][row]) if len(data) else start
                hot = (sums[stop] - sums[start]) > least * width
                edge = np.bincount(start[hot], minlength=len(data) + 1) - np.bincount(stop[hot], minlength=len(data) + 1)
                inside[kind] = np.cumsum(edge[:-1]) > 0
            found = {k: np.zeros(n) for k in ("template", "filler", "notice")}
            body = data.tobytes()
            raw = lambda i: body[bounds[i] : bounds[i + 1]]  # noqa: B023, E731
            for i, a, b in _runs(inside["template"] | inside["shape"], row, bounds):
                if _field_in(raw(i), a, b):
                    found["template"][i] += (b - a) / lengths[i]
            for i, a, b in _runs(inside["filler"], row, bounds):
                if b - a >= STRETCH and _filler_in(raw(i), a, b, inside["filler"][bounds[i] : bounds[i + 1]]):
                    found["filler"][i] += (b - a) / lengths[i]
            noticed = np.bincount(row, weights=inside["notice"], minlength=n) / np.maximum(1, lengths)
            for i in np.flatnonzero(noticed >= 0.1):
                found["notice"][i] = _notice_share(raw(i), tables.value["notice"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found.values())], [key, *found])

    kind = dict(documents.select(key).dtypes)[key]
    return documents.select(key, text).mapInArrow(score, f"`{key}` {kind}, template double, filler double, notice double")


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of documents that are, or contain, residue; see :func:`residue_cover`."""
    cover = residue_cover(documents, key, text)
    return cover.filter((F.col("template") > 0) | (F.col("filler") > 0) | (F.col("notice") >= COVERAGE)).select(key).distinct()


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without those that are, or contain, residue."""
    return documents.join(residue_documents(documents, key, text), key, "left_anti")
