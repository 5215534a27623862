"""Readers of text formats: bytes of a file in, one record out.

Each reader gives (content, metadata of strings, tables of cells). They are
plain functions, applied in Arrow batches by ``quire.plans.extraction``: these
grammars are beyond built-in functions. Any error of a reader becomes the
row's error, never the job's.
"""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import io
import json
import re
import tarfile
import tomllib
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from xml.etree import ElementTree

from quire.functions.html import to_markdown
from quire.sources.structured import flat_yaml, walk

# Limits against hostile input.
ARCHIVE_BYTES, RATIO, FILES, CONTENT_BYTES, XML_DEPTH, CELLS = 500 << 20, 100, 10_000, 100 << 20, 100, 100_000
MEMBERS = (".txt", ".md", ".json", ".xml", ".html", ".csv", ".log", ".yaml", ".toml")
DELIMITERS = ",\t|;"


class FormatError(ValueError):
    """A file that its reader refuses."""


@dataclass
class Record:
    content: str
    metadata: dict[str, str] = field(default_factory=dict)
    tables: list[list[list[str]]] = field(default_factory=list)


def decoded(data: bytes) -> str:
    """UTF-8, by BOM UTF-16, else Windows-1252; never fails."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def counts(text: str) -> dict[str, str]:
    return {"line_count": str(len(text.splitlines())), "word_count": str(len(text.split())), "character_count": str(len(text.encode()))}


def plain(data: bytes) -> Record:
    text = decoded(data).rstrip("\n")
    return Record(text, counts(text))


def frontmatter(text: str) -> tuple[dict, str]:
    """The YAML block between rules at the start, and what follows it."""
    m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.DOTALL)
    return (flat_yaml(m[1]), text[m.end() :]) if m else ({}, text)


def pipe_tables(text: str) -> list[list[list[str]]]:
    """Tables of consecutive pipe lines, rules and empty cells left out; more than one row."""
    out: list[list[list[str]]] = []
    rows: list[list[str]] = []
    for line in [*text.splitlines(), ""]:
        s = line.strip()
        if s.startswith("|"):
            if not re.fullmatch(r"\|[|:\s-]*\|?", s):
                rows.append([c.strip() for c in s.strip("|").split("|") if c.strip()])
        elif rows:
            if len(rows) > 1:
                out.append(rows)
            rows = []
    return out


def markdown(data: bytes) -> Record:
    meta, body = frontmatter(decoded(data))
    outside = re.sub(r"(?ms)^```.*?^```", "", body)
    found = {k: ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in meta.items() if v is not None}
    headers = re.findall(r"(?m)^#{1,6}\s+(.+?)\s*$", outside)
    if "title" not in found and (top := re.search(r"(?m)^# (.+?)\s*$", outside)):
        found["title"] = top[1]
    links = re.findall(r"\[([^\]]+)\]\(([^)]+)\)", outside)
    code = re.findall(r"(?ms)^```(\w*)\n(.*?)^```", body)
    found |= {"headers": json.dumps(headers), "links": json.dumps(links), "code_blocks": json.dumps([(lang or "plain", c) for lang, c in code])}
    return Record(body.strip(), found | counts(body.strip()), pipe_tables(outside))


def csv_rows(text: str, delimiter: str) -> list[list[str]]:
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, doublequote=True)
    return [r for r in rows if any(c.strip() for c in r)]


def delimiter_of(text: str) -> str:
    """The candidate whose rows of the first row's width, times that width, are most, over ten lines."""
    sample = "\n".join(text.splitlines()[:10])
    best, score = ",", 0
    for d in DELIMITERS:
        widths = [len(r) for r in csv_rows(sample, d)]
        if len(widths) > 1 and widths[0] > 1 and (s := widths.count(widths[0]) * widths[0]) > score:
            best, score = d, s
    return best


def delimited(data: bytes, delimiter: str | None = None) -> Record:
    text = decoded(data)
    csv.field_size_limit(1 << 30)
    rows = csv_rows(text, delimiter or delimiter_of(text))
    if sum(map(len, rows)) > CELLS:
        raise FormatError(f"more than {CELLS} cells")
    content = "\n".join(" ".join(c.strip() for c in r if c.strip()) for r in rows)
    return Record(content, {"row_count": str(len(rows)), "column_count": str(max(map(len, rows), default=0))}, [rows] if rows else [])


def structured(data: bytes, kind: str) -> Record:
    text = decoded(data)
    value = {"json": json.loads, "toml": tomllib.loads, "yaml": flat_yaml}[kind](text)
    fields = list(walk(value))
    content = json.dumps(value, indent=2, ensure_ascii=False) if kind == "json" else text
    return Record(content, {p: v for p, v, is_text in fields if is_text} | {"field_count": str(len(fields))})


def _tag(name: str) -> str:
    return name.rpartition("}")[2]


def xml(data: bytes) -> Record:
    """"tag: text" and "tag[attribute]: value" lines, counts and names of elements."""
    lines, names, depth = [], Counter(), 0
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        parser.feed(data)
        parser.close()
        events = [(kind, _tag(e.tag), e.attrib, e.text) for kind, e in parser.read_events()]
    except ElementTree.ParseError:
        events = tags_as_they_come(decoded(data))  # a mismatched tag doesn't end reading
    for kind, tag, attributes, text in events:
        if kind == "start":
            depth += 1
            if depth > XML_DEPTH:
                raise FormatError(f"deeper than {XML_DEPTH} elements")
            names[tag] += 1
            lines += [f"{tag}[{_tag(k)}]: {v}" for k, v in attributes.items()]
        else:
            depth -= 1
            if text and text.strip():
                lines.append(f"{tag}: {' '.join(text.split())}")
    if not names:
        raise FormatError("no XML element")
    return Record("\n".join(lines), {"element_count": str(sum(names.values())), "unique_elements": ", ".join(sorted(names))})


MARKUP = re.compile(r"""<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<[?!][^>]*>|<(?P<close>/?)(?P<tag>[^\s<>/]+)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+)|<""", re.DOTALL)


def tags_as_they_come(text: str) -> list[tuple[str, str, dict[str, str], str | None]]:
    """(start or end, tag, attributes, text) of markup that isn't well formed: a closing tag closes
    what stands open up to its like, and nothing where there is none; the end closes all. An element's
    text is that before its first child."""
    out: list[tuple[str, str, dict[str, str], str | None]] = []
    open_: list[list] = []  # [tag, text, whether a child has come]

    def close() -> None:
        tag, body, _ = open_.pop()
        out.append(("end", tag, {}, body))

    for m in MARKUP.finditer(text):
        body = m["raw"] if m["raw"] is not None else unescape(m["text"]) if m["text"] else None
        if body is not None:
            if open_ and not open_[-1][2]:
                open_[-1][1] += body
        elif m["tag"] and m["close"]:
            tag = m["tag"].rpartition(":")[2]
            if any(o[0] == tag for o in open_):
                while open_[-1][0] != tag:
                    close()
                close()
        elif m["tag"]:
            if open_:
                open_[-1][2] = True
            tag = m["tag"].rpartition(":")[2]
            found = re.findall(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", m["rest"])
            out.append(("start", tag, {k.rpartition(":")[2]: unescape(a or b) for k, a, b in found if not k.startswith("xmlns")}, None))
            open_.append([tag, "", False])
            if m["rest"].rstrip().endswith("/"):
                close()
    while open_:
        close()
    return out


#: Vocabularies: where titles and authors are, tags of paragraphs and of headings.
VOCABULARIES = {
    "fictionbook": (("book-title",), ("author",), {"p", "v", "subtitle"}, {"title"}),
    "docbook": (("title",), ("author", "personname"), {"para", "simpara", "programlisting"}, {"title"}),
    "jats": (("article-title",), ("contrib",), {"p"}, {"title", "article-title"}),
    "opml": (("title",), ("ownerName",), set(), set()),
}


def vocabulary(data: bytes, name: str) -> Record:
    titles, authors, paragraphs, heads = VOCABULARIES[name]
    root = ElementTree.fromstring(data)
    text = lambda e: " ".join("".join(e.itertext()).split())
    meta, out, tables = {}, [], []
    people = []
    for e in root.iter():
        tag = _tag(e.tag)
        if tag in titles and "title" not in meta and text(e):
            meta["title"] = text(e)
        if tag in authors and text(e):
            people.append(" ".join(x for x in (text(c) for c in e) if x) or text(e))
        if tag in heads and text(e):
            out.append(f"# {text(e)}")
        elif tag in paragraphs and text(e):
            out.append(text(e))
        elif tag == "outline" and (label := e.get("text") or e.get("title")):
            out.append(label)
        elif tag in ("table", "informaltable"):
            rows = [[text(c) for c in r if _tag(c.tag) in ("td", "th", "entry")] for r in e.iter() if _tag(r.tag) in ("tr", "row")]
            tables += [rows] if rows else []
    if people:
        meta["authors"] = ", ".join(dict.fromkeys(people))
    return Record("\n\n".join(out), meta, tables)


def html(data: bytes) -> Record:
    page = decoded(data)
    content = to_markdown(page) or ""
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    metas = re.findall(r"""(?is)<meta\s+name\s*=\s*["']([^"']*)["']\s+content\s*=\s*["']([^"']*)["']""", page)
    return Record(content, ({"title": " ".join(title[1].split())} if title else {}) | {k.lower(): v for k, v in metas}, pipe_tables(content))


def mail(data: bytes) -> Record:
    """Headers, the plain part or else the stripped HTML one, attachments by name."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", text))).strip()
    named = {k.lower(): str(m[k]) for k in ("Subject", "From", "To", "Cc", "Bcc", "Date", "Message-ID") if m[k]}
    files = [a.get_filename() or "" for a in m.iter_attachments()]
    head = [f"{k}: {named[k.lower()]}" for k in ("Subject", "From", "To", "Cc", "Bcc", "Date") if k.lower() in named]
    return Record("\n".join([*head, "", text.strip()]).strip(), named | {"attachments": json.dumps(files)})


def _checked(name: str, size: int, packed: int, total: int, n: int) -> None:
    if n > FILES or total > ARCHIVE_BYTES or (packed and size / packed > RATIO and size > 1 << 20):
        raise FormatError(f"archive limits exceeded at {name}")


def archive(data: bytes, kind: str) -> Record:
    """A listing, and the text of members with text extensions; members aren't unpacked further."""
    names, parts, total = [], [], 0
    if kind == "gzip":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            text = f.read(CONTENT_BYTES + 1)
        if len(text) > CONTENT_BYTES or len(text) > RATIO * max(len(data), 1 << 14):
            raise FormatError("archive limits exceeded")
        if text[257:262] == b"ustar":
            return archive(text, "tar")
        return Record(decoded(text), {"file_count": "1", "total_size": str(len(text))})
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                total += i.file_size
                _checked(i.filename, i.file_size, i.compress_size, total, len(names) + 1)
                names.append(i.filename)
                if not i.is_dir() and i.filename.lower().endswith(MEMBERS):
                    parts.append(f"=== {i.filename} ===\n{decoded(z.read(i))}")
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for i in t:
                total += i.size
                _checked(i.name, i.size, 0, total, len(names) + 1)
                names.append(i.name)
                if i.isfile() and i.name.lower().endswith(MEMBERS):
                    parts.append(f"=== {i.name} ===\n{decoded(t.extractfile(i).read())}")
    return Record("\n\n".join(["Files:\n" + "\n".join(names), *parts]), {"file_count": str(len(names)), "total_size": str(total), "files": json.dumps(names)})


def bibtex(data: bytes) -> Record:
    text = decoded(data)
    entries = re.findall(r"@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\}", text + "\n}", re.DOTALL)
    entries = [(k.lower(), key, body) for k, key, body in entries if k.lower() not in ("comment", "string", "preamble")]
    of = lambda body, name: (m := re.search(rf"(?is)\b{name}\s*=\s*(?:\{{(.*?)\}}\s*(?:,|$)|\"(.*?)\"|(\w+))", body)) and next(g for g in m.groups() if g is not None)
    authors = sorted({a.strip() for _, _, b in entries for a in re.split(r"\s+and\s+", of(b, "author") or "") if a.strip()})
    years = sorted(int(y[0]) for _, _, b in entries if (y := re.search(r"\d{4}", of(b, "year") or "")))
    kinds = Counter(k for k, _, _ in entries)
    meta = {"entry_count": str(len(entries)), "authors": ", ".join(authors), "citation_keys": ", ".join(key for _, key, _ in entries), "entry_types": json.dumps(dict(sorted(kinds.items())))}
    return Record(text.strip(), meta | ({"year_min": str(years[0]), "year_max": str(years[-1])} if years else {}))


def citations(data: bytes) -> Record:
    """RIS ("TY  - ") and PubMed ("PMID- ") lines; EndNote XML by its records."""
    text = decoded(data)
    if text.lstrip().startswith("<"):
        root = ElementTree.fromstring(data)
        get = lambda r, n: ["".join(e.itertext()).strip() for e in r.iter() if _tag(e.tag) == n]
        rows = [{"T": get(r, "title"), "A": get(r, "author"), "Y": get(r, "year"), "D": get(r, "electronic-resource-num"), "K": get(r, "keyword")} for r in root.iter() if _tag(r.tag) == "record"]
    else:
        tags = {"TI": "T", "T1": "T", "AU": "A", "A1": "A", "FAU": "A", "PY": "Y", "Y1": "Y", "DP": "Y", "DO": "D", "LID": "D", "KW": "K", "OT": "K"}
        rows = []
        for line in text.splitlines():
            m = re.match(r"([A-Z][A-Z0-9]{1,3}) *- ?(.*)", line)
            if m and m[1] in ("TY", "PMID"):
                rows.append({k: [] for k in "TAYDK"})
            elif m and rows and m[1] in tags and m[2].strip():
                rows[-1][tags[m[1]]].append(m[2].strip())
    years = sorted({int(y[0]) for r in rows for v in r["Y"] if (y := re.search(r"\d{4}", v))})
    join = lambda k: ", ".join(sorted({v for r in rows for v in r[k]}))
    content = "\n\n".join("\n".join(filter(None, ["; ".join(r["T"]), ", ".join(r["A"]), ", ".join(r["Y"])])) for r in rows)
    return Record(content, {"citation_count": str(len(rows)), "authors": join("A"), "dois": join("D"), "keywords": join("K"), "years": ", ".join(map(str, years))})


def notebook(data: bytes) -> Record:
    nb = json.loads(decoded(data))
    joined = lambda s: "".join(s) if isinstance(s, list) else (s or "")
    out = []
    for k, c in enumerate(nb.get("cells", [])):
        body = joined(c.get("source"))
        if c.get("cell_type") == "code":
            body = f"```\n{body}\n```"
            for o in c.get("outputs", []):
                shown = joined(o.get("text")) or joined((o.get("data") or {}).get("text/plain")) or "\n".join(o.get("traceback", []))
                body += f"\n\n{shown.strip()}" if shown.strip() else ""
        out.append(f":::: {{#{c.get('id', f'cell-{k}')} .cell .{c.get('cell_type', 'raw')}}}\n{body}\n::::")
    meta = nb.get("metadata", {})
    return Record("\n\n".join(out), {"kernel": str(meta.get("kernelspec", {}).get("name", "")), "language": str(meta.get("language_info", {}).get("name", "")), "nbformat": str(nb.get("nbformat", "")), "cell_count": str(len(nb.get("cells", [])))})


def latex(data: bytes) -> Record:
    text = re.sub(r"(?<!\\)%.*", "", decoded(data))
    of = lambda name: (m := re.search(rf"\\{name}\s*\{{([^}}]*)\}}", text)) and m[1].strip()
    meta = {k: v for k in ("title", "author", "date") if (v := of(k))}
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|$)", text, re.DOTALL)
    t = body[1] if body else text
    tables = [[[c.strip() for c in row.split("&")] for row in re.sub(r"\\hline|\\toprule|\\midrule|\\bottomrule", "", x).split(r"\\") if row.strip()] for x in re.findall(r"\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}", t, re.DOTALL)]
    for level, name in enumerate(("section", "subsection", "subsubsection"), 1):
        t = re.sub(rf"\\{name}\*?\{{([^}}]*)\}}", lambda m, n=level: f"\n{'#' * n} {m[1]}\n", t)
    t = re.sub(r"\\item\s*", "\n- ", t)
    t = re.sub(r"\\(?:textbf|textit|emph|texttt|underline)\{([^}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", "", t)
    return Record(re.sub(r"\n{3,}", "\n\n", re.sub(r"[{}~]", " ", t).replace(r"\\", "\n")).strip(), meta, tables)


def rst(data: bytes) -> Record:
    lines, out, meta = decoded(data).splitlines(), [], {}
    for k, line in enumerate(lines):
        if re.fullmatch(r"([=\-~^\"'#*+])\1{2,}", line.strip()) and k and lines[k - 1].strip():
            out[-1] = f"# {lines[k - 1].strip()}"
            meta.setdefault("title", lines[k - 1].strip())
        elif m := re.match(r":(\w+): (.+)", line):
            meta[m[1].lower()] = m[2]
        elif not re.match(r"\.\. ", line) and not re.fullmatch(r"([=\-~^\"'#*+])\1{2,}", line.strip()):
            out.append(re.sub(r"``([^`]*)``|:\w+:`([^`<]*?)(?: <[^>]*>)?`", lambda x: x[1] or x[2] or "", line))
    return Record(re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), meta, pipe_tables(decoded(data)))


def org(data: bytes) -> Record:
    text = decoded(data)
    meta = {k.lower(): v.strip() for k, v in re.findall(r"(?m)^#\+(TITLE|AUTHOR|DATE|KEYWORDS): *(.+)$", text)}
    body = re.sub(r"(?m)^#\+.*$|^ *:[A-Z_]+:.*$", "", text)
    body = re.sub(r"(?m)^(\*+) ", lambda m: "#" * len(m[1]) + " ", body)
    body = re.sub(r"\[\[([^\]]*)\]\[([^\]]*)\]\]", r"\2", body)
    return Record(re.sub(r"\n{3,}", "\n\n", body).strip(), meta, pipe_tables(re.sub(r"(?m)^\|[-+]+\|$", "|---|", text)))


def typst(data: bytes) -> Record:
    text = re.sub(r"//.*", "", decoded(data))
    meta = dict(re.findall(r"(title|author|date):\s*\"([^\"]*)\"", text))
    body = re.sub(r"(?m)^(=+) ", lambda m: "#" * len(m[1]) + " ", re.sub(r"(?m)^#(?:set|show|import|let)\b.*$", "", text))
    tables = []
    for columns, cells in re.findall(r"#table\(\s*columns:\s*(\d+)\s*,(.*?)\)", text, re.DOTALL):
        values = re.findall(r"\[([^\]]*)\]", cells)
        tables.append([values[i : i + int(columns)] for i in range(0, len(values), int(columns))])
    return Record(re.sub(r"\n{3,}", "\n\n", re.sub(r"#\w+\([^)]*\)", "", body)).strip(), meta, tables)


def rtf(data: bytes) -> Record:
    """Text of the groups that aren't destinations; bytes by Windows-1252, \\u by code point."""
    text, out, stack, skip, after = data.decode("latin-1"), [], [], False, 0
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "datastore", "listtable", "listoverridetable"}
    meta = {}
    for m in re.finditer(r"\\(?:([a-zA-Z]+)(-?\d+)? ?|'([0-9a-fA-F]{2})|(.))|([{}])|([^\\{}\r\n]+)", text, re.DOTALL):
        word, number, byte, sign, brace, run = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in hidden or sign == "*":
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            after = 1
        elif byte:
            if not after:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
            after = 0
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif run:
            out.append(run[after:])
            after = 0
    for name in ("title", "author", "subject", "keywords"):
        if f := re.search(rf"\{{\\{name} ([^}}]*)\}}", text):
            meta[name] = f[1]
    if d := re.search(r"\\creatim((?:\\(?:yr|mo|dy|hr|min)\d+)+)", text):
        v = dict(re.findall(r"\\([a-z]+)(\d+)", d[1]))
        meta["created_at"] = f"{int(v.get('yr', 0)):04}-{int(v.get('mo', 1)):02}-{int(v.get('dy', 1)):02}T{int(v.get('hr', 0)):02}:{int(v.get('min', 0)):02}:00Z"
    return Record(re.sub(r"\n{3,}", "\n\n", "".join(out)).strip(), meta)


def column_of(reference: str) -> int:
    """The column's number, from 1, in a cell reference such as B3; 0 if it has none."""
    n = 0
    for c in reference:
        if not "A" <= c <= "Z":
            break
        n = 26 * n + ord(c) - 64
    return n if n <= 16384 else 0


def ooxml(data: bytes, main: str) -> Record:
    """Paragraph texts and tables of a word document, slides, or sheets, with core properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        total = 0
        for k, i in enumerate(z.infolist()):
            total += i.file_size
            _checked(i.filename, i.file_size, i.compress_size, total, k + 1)
        names = z.namelist()
        read = lambda n: ElementTree.fromstring(z.read(n))
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        text = lambda e: "".join(t.text or "" for t in e.iter() if _tag(t.tag) == "t")
        parts, tables, sheets = [], [], []
        if main == "word":
            body = read("word/document.xml")
            parts = [text(p) for p in body.iter() if _tag(p.tag) == "p" and text(p)]
            tables = [[[text(c) for c in r if _tag(c.tag) == "tc"] for r in t if _tag(r.tag) == "tr"] for t in body.iter() if _tag(t.tag) == "tbl"]
        elif main == "ppt":
            for n in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
                parts.append(f"<!-- Slide {number(n)} -->\n" + "\n".join(t for p in read(n).iter() if _tag(p.tag) == "p" and (t := text(p))))
        else:
            shared = [text(s) for s in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
            for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
                rows = []
                for r in (e for e in read(n).iter() if _tag(e.tag) == "row"):
                    cells: dict[int, str] = {}
                    for c in r:
                        v = next((x.text or "" for x in c if _tag(x.tag) == "v"), text(c))
                        # A cell without a reference stands behind the one before it.
                        at = column_of(c.get("r", "")) or max(cells, default=0) + 1
                        cells[at] = shared[int(v)] if c.get("t") == "s" and v else v
                    rows.append([cells.get(k, "") for k in range(1, max(cells, default=0) + 1)])
                    if sum(map(len, rows)) > CELLS:
                        raise FormatError(f"more than {CELLS} cells")
                tables.append(rows)
                parts.append("\n".join(" ".join(x for x in r if x) for r in rows))
            if "xl/workbook.xml" in names:
                sheets = [e.get("name", "") for e in read("xl/workbook.xml").iter() if _tag(e.tag) == "sheet"]
        meta = {}
        if "docProps/core.xml" in names:
            meta = {_tag(e.tag): e.text for e in read("docProps/core.xml") if e.text}
        if sheets:
            meta |= {"sheet_names": json.dumps(sheets), "sheet_count": str(len(sheets))}
    return Record("\n\n".join(parts), meta, [t for t in tables if t])


def opened(data: bytes, kind: str) -> Record:
    """ODT text by content.xml; EPUB chapters by the spine of its package."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda n: ElementTree.fromstring(z.read(n))
        text = lambda e: " ".join("".join(e.itertext()).split())
        if kind == "odt":
            root = read("content.xml")
            parts = [("# " if _tag(e.tag) == "h" else "") + text(e) for e in root.iter() if _tag(e.tag) in ("h", "p") and text(e)]
            tables = [[[text(c) for c in r if _tag(c.tag) == "table-cell"] for r in t.iter() if _tag(r.tag) == "table-row"] for t in root.iter() if _tag(t.tag) == "table"]
            meta = {_tag(e.tag): e.text for e in read("meta.xml").iter() if e.text and e.text.strip()} if "meta.xml" in z.namelist() else {}
            return Record("\n\n".join(parts), meta, tables)
        package = next(e.get("full-path") for e in read("META-INF/container.xml").iter() if _tag(e.tag) == "rootfile")
        root, base = read(package), package.rpartition("/")[0]
        files = {e.get("id"): e.get("href") for e in root.iter() if _tag(e.tag) == "item"}
        spine = [files[e.get("idref")] for e in root.iter() if _tag(e.tag) == "itemref" and e.get("idref") in files]
        meta = {_tag(e.tag): e.text for e in root.iter() if e.text and e.text.strip() and _tag(e.tag) in ("title", "creator", "language", "publisher", "date", "identifier", "subject", "description")}
        return Record("\n\n".join(to_markdown(decoded(z.read(f"{base}/{h}" if base else h))) or "" for h in spine).strip(), meta)


# Names of the EXIF tags that are told.
EXIF = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def tags_of(data: bytes) -> dict[int, str]:
    """Tags of the first directory of a TIFF block and of its EXIF directory, values as text."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if not order:
        return {}
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    out: dict[int, str] = {}
    left, seen = [number(4, 4)], set()
    while left:
        at = left.pop()
        if at in seen or not 8 <= at <= len(data) - 2:
            continue
        seen.add(at)
        for k in range(min(number(at, 2), 512)):
            entry = at + 2 + 12 * k
            tag, kind, n = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            size = SIZES.get(kind, 0) * n
            place = entry + 8 if size <= 4 else number(entry + 8, 4)
            if tag == 0x8769:
                left.append(number(entry + 8, 4))
            elif not size or place + size > len(data) or entry + 12 > len(data):
                continue
            elif kind == 2:
                out[tag] = data[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind == 5:
                out[tag] = f"{number(place, 4)}/{number(place + 4, 4)}"
            else:
                out[tag] = str(number(place, SIZES[kind]))
    return out


def jpeg(data: bytes) -> tuple[int, int, dict[int, str]]:
    at, width, height, tags = 2, 0, 0, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in range(0xC0, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
            height, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (5, 7))
            break
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tags = tags_of(data[at + 10 : at + 2 + size])
        if size < 2:
            break
        at += 2 + size
    return width, height, tags


def image(data: bytes) -> Record:
    """Format, size and EXIF tags from an image's header; pixels aren't decoded."""
    big = lambda a, b: int.from_bytes(data[a:b], "big")
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    tags: dict[int, str] = {}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        name, width, height = "PNG", big(16, 20), big(20, 24)
    elif data[:3] == b"\xff\xd8\xff":
        name, (width, height, tags) = "JPEG", jpeg(data)
    elif data[:4] == b"GIF8":
        name, width, height = "GIF", little(6, 8), little(8, 10)
    elif data[:2] == b"BM":
        name, width, height = "BMP", little(18, 22), abs(int.from_bytes(data[22:26], "little", signed=True))
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        name, kind = "WEBP", data[12:16]
        if kind == b"VP8X":
            width, height = little(24, 27) + 1, little(27, 30) + 1
        elif kind == b"VP8L":
            bits = little(21, 25)
            width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        else:
            width, height = little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    elif data[:4] in (b"II*\0", b"MM\0*"):
        name, tags = "TIFF", tags_of(data)
        width, height = int(tags.get(0x0100, 0)), int(tags.get(0x0101, 0))
    elif re.match(rb"P[1-6]\s", data):
        found = re.findall(rb"\d+", re.sub(rb"#[^\n]*", b"", data[2:512]))
        name, width, height = "PNM", int(found[0]) if found else 0, int(found[1]) if len(found) > 1 else 0
    elif data[4:8] == b"jP  " and (at := data.find(b"ihdr", 0, 4096)) > 0:
        name, height, width = "JP2", big(at + 4, at + 8), big(at + 8, at + 12)
    else:
        raise FormatError("no image header that is known")
    if not width or not height:
        raise FormatError(f"no size in a {name} header")
    found = {EXIF[t]: v for t, v in sorted(tags.items()) if t in EXIF and v}
    return Record(f"Image: {name} {width}x{height}", {"format": name, "width": str(width), "height": str(height)} | found)


#: MIME type to reader; office types by their main part.
READERS = {
    "text/plain": plain,
    "text/markdown": markdown,
    "text/x-commonmark": markdown,
    "text/x-djot": markdown,
    "text/csv": delimited,
    "text/tab-separated-values": lambda d: delimited(d, "\t"),
    "application/json": lambda d: structured(d, "json"),
    "application/x-yaml": lambda d: structured(d, "yaml"),
    "application/toml": lambda d: structured(d, "toml"),
    "application/xml": xml,
    "text/xml": xml,
    "image/svg+xml": xml,
    "text/html": html,
    "message/rfc822": mail,
    "application/zip": lambda d: archive(d, "zip"),
    "application/x-tar": lambda d: archive(d, "tar"),
    "application/gzip": lambda d: archive(d, "gzip"),
    "application/x-bibtex": bibtex,
    "application/x-research-info-systems": citations,
    "application/x-pubmed": citations,
    "application/x-endnote+xml": citations,
    "application/x-ipynb+json": notebook,
    "application/x-latex": latex,
    "text/x-rst": rst,
    "text/x-org": org,
    "application/x-typst": typst,
    "application/rtf": rtf,
    "application/x-fictionbook+xml": lambda d: vocabulary(d, "fictionbook"),
    "application/docbook+xml": lambda d: vocabulary(d, "docbook"),
    "application/x-jats+xml": lambda d: vocabulary(d, "jats"),
    "application/xml+opml": lambda d: vocabulary(d, "opml"),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": lambda d: ooxml(d, "word"),
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": lambda d: ooxml(d, "ppt"),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": lambda d: ooxml(d, "xl"),
    "application/vnd.oasis.opendocument.text": lambda d: opened(d, "odt"),
    "application/epub+zip": lambda d: opened(d, "epub"),
    **{f"image/{kind}": image for kind in ("png", "jpeg", "gif", "bmp", "webp", "tiff", "jp2", "x-portable-anymap", "x-portable-bitmap", "x-portable-graymap", "x-portable-pixmap")},
}
