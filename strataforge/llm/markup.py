"""Problem 5: clean text from HTML, Markdown, wiki and LaTeX markup, by tag-path ratios.

A record of any markup becomes one sequence of nodes, each with a root-to-leaf tag path (``body/ul/li``) and its text:
HTML tags as they stand, the blocks of the other three under the tags they mean. Per path the text length and
punctuation per node are aggregated (text-to-path and punctuation-to-path ratios), both are smoothed along the
sequence, fused by their product, and nodes of paths under a threshold are dropped as page furniture. Headings, lists, code, formulas and
tables are content wherever they stand; they come out in one plain notation.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
ELEMENTS = set(
    """a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption
    center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
    form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu
    meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search
    section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title
    tr track tt u ul var video wbr""".split()
)
# Elements that begin a new block, and page furniture.
BLOCK_TAGS = set("p div li h1 h2 h3 h4 h5 h6 tr table ul ol dl dt dd blockquote pre section article header footer nav aside main details summary figure figcaption center form br hr body html head title iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav footer aside script style noscript form iframe button menu".split())
# LaTeX commands without an argument that occur in text or formulas.
SYMBOLS = set(
    """item par noindent maketitle tableofcontents newpage clearpage hline toprule midrule bottomrule centering LaTeX TeX ldots dots cdots
    alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega
    Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega leq geq neq le ge ne approx equiv sim times cdot pm mp div sum prod int oint partial
    nabla infty in notin subset subseteq cup cap forall exists to rightarrow leftarrow Rightarrow log ln exp sin cos tan min max lim left
    right quad qquad textbackslash bigskip medskip smallskip""".split()
)

KINDS = ("html", "markdown", "wiki", "latex")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*)\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])?)(\{)?")
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}((?:\{[^}\n]*\}|\[[^\]\n]*\])*)")
_WIKILINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_TEMPLATE = re.compile(r"\{\{([A-Za-z#][^{}]*)\}\}")
_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?!')(\S(?:[^'\n]|'(?!'))*?)\1(?!')")
_EXTERNAL = re.compile(r"(?<![\]\w!])\[((?:https?|ftp)://[^\s\]]+)\s+([^\]\n]+)\](?!\()")
_LINK = re.compile(r"(!?)(?<!%)\[([^\[\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)?)(?:\s+[\"'][^\n]*?[\"'])?\)")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_STRONG = re.compile(r"(?<![\w*])(\*\*|\*\*\*)(?![\s*])([^*\n]*[^\s*\n])\1(?!\*)|(?<![\w_])(__)(?![\s_])([^_\n]*[^\s_\n])__(?![\w_])")
_EM = re.compile(r"(?<![\w*\\])\*(?![\s*.])([^*\n]*[^\s*\n])\*(?![\w*])|(?<![\w_\\])_(?![\s_])([^_\n]*[^\s_\n])_(?![\w_])")
_STRIKE = re.compile(r"(?<!~)~~(?![\s~])([^~\n]*[^\s~\n])~~(?!~)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\n]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*)$")
_WIKI_HEADING = re.compile(r"(={1,6})\s*([^=\s].*?)\s*\1\s*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BULLET = re.compile(r"( {0,3})([-+*])[ \t]+(\S.*)$")
_ORDERED = re.compile(r"( {0,3})(\d{1,9}[.)])[ \t]+(\S.*)$")
_NESTED = re.compile(r"([*#:;]{2,})\s*([^\s*#:;].*)$")
_DEFINITION = re.compile(r"([:;])\s*(\S.*)$")
_QUOTE = re.compile(r" {0,3}>[ \t]?(.*)$")
_DELIMITER = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}")
_FORMULA_ENV = re.compile(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)(\*?)\}")
_EMBED = re.compile(r"%\[([^\]\n]*)\]")
#: Without one of these no kind of markup can be present.
_ANY = re.compile(r"[<&`\\$*~|>{\[]|''|^[^\S\n]*(?:#|[-+:;][^\S\n]*\S|=|\d+[.)]\s)|_\S|^ ", re.M)


@dataclass
class Record:
    """What one text consists of: nodes (tag path, kind of node, text) and the markup seen."""

    nodes: list[tuple[str, str, str]] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)
    shared: int = 0  # line markers that fit Markdown and wiki alike

    def mark(self, kind: str, n: int = 1) -> None:
        self.seen[kind] = self.seen.get(kind, 0) + n

    def kinds(self) -> list[str]:
        """The kinds present; a marker that fits two kinds belongs to the one that other markup shows, else to Markdown."""
        out = {k for k, n in self.seen.items() if n}
        if self.shared and not out & {"markdown", "wiki"}:
            out.add("markdown")
        return [k for k in KINDS if k in out]


def _is_command(match: re.Match) -> bool:
    before = match.string[match.start() - 1 : match.start()]
    if before == "\\":
        return False
    return bool(match[3]) or (match[1] in SYMBOLS and before != ":" and not before.isalnum())


def _inline(text: str, record: Record) -> str:
    """Plain text of a run without code blocks; records the markup of each kind."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x01"

    def seen(kind: str, value: str) -> str:
        record.mark(kind)
        return value

    if "`" in text:
        text = _SPAN.sub(lambda m: seen("markdown", keep(f"`{m[2].strip()}`")), text)
    if "<" in text:
        text = re.sub(r"(?is)<(code|tt|samp|kbd)(?:\s[^<>]*)?>(.*?)</\1\s*>", lambda m: seen("html", keep(f"`{html.unescape(_TAG.sub('', m[2])).strip()}`")), text)
        text = _COMMENT.sub(lambda m: seen("html", ""), text)
        text = _AUTOLINK.sub(lambda m: seen("markdown", m[1]), text)

        def tag(m: re.Match) -> str:
            name = m[2].lower()
            if name not in ELEMENTS:
                return m[0]
            record.mark("html")
            if name == "img":
                alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", m[3])
                return alt[1] if alt else ""
            return "\n" if name in BLOCK_TAGS else ""

        text = _TAG.sub(tag, text)
    if "$" in text or "\\" in text:
        text = _MATH.sub(lambda m: seen("latex", keep(f"$${(m[1] or m[2] or m[3]).strip()}$$")), text)

        def dollar(m: re.Match) -> str:
            if re.search(r"[\\_^{}=]", m[1]) or re.fullmatch(r"[A-Za-z]", m[1]):
                return seen("latex", keep(f"${m[1]}$"))
            return m[0]

        text = _DOLLAR.sub(dollar, text)
    if "\\" in text:
        text = _ENV.sub(lambda m: seen("latex", ""), text)

        def command(m: re.Match) -> str:
            if not _is_command(m):
                return m[0]
            record.mark("latex")
            if m[1] in ("cite", "ref", "label", "pageref", "eqref", "footnote", "includegraphics", "vspace", "hspace"):
                return f"\x02{m[1]}\x03" if m[3] else ""
            return "\x04" if m[3] else ("\n- " if m[1] == "item" else "")

        if _COMMAND.search(text):
            text = _COMMAND.sub(command, text)
            text = re.sub(r"\x02(cite|ref|label|pageref|eqref|includegraphics|vspace|hspace)\x03[^{}]*\}", "", text)
            text = re.sub(r"\x02footnote\x03([^{}]*)\}", r" (\1)", text)
            while "\x04" in text:
                text, n = re.subn(r"\x04([^{}\x04]*)\}", r"\1", text)
                if not n:
                    break
            text = re.sub(r"[\x02\x04]|footnote\x03|\x03", "", text)
    if "latex" in record.seen:
        text = re.sub(r"\\([_&%#${}])", r"\1", text)
        text = re.sub(r"(?<=\w)~(?=\s|\x00|\w|$)", " ", text)
    if "{{" in text:
        n = 1
        while n:
            text, n = _TEMPLATE.subn(lambda m: seen("wiki", m[1].split("|", 1)[1] if m[1].startswith("quote|") else ""), text)
    if "[" in text:
        text = _WIKILINK.sub(lambda m: seen("wiki", m[2] or m[1]) if re.search(r"[^\W\d_]", m[1]) and m[1][0] not in "\"'" else m[0], text)
        text = _EXTERNAL.sub(lambda m: seen("wiki", m[2]), text)
        text = _EMBED.sub(lambda m: m[1], text)
        n = 1
        while n:
            text, n = _LINK.subn(lambda m: seen("markdown", m[2]), text)
    if "''" in text:
        n = 1
        while n:
            text, n = _QUOTES.subn(lambda m: seen("wiki", m[2]), text)
    if "*" in text or "_" in text:
        n = k = 1
        while n + k:
            text, n = _STRONG.subn(lambda m: seen("markdown", m[2] or m[4]), text)
            text, k = _EM.subn(lambda m: seen("markdown", m[1] or m[2]), text)
    if "~~" in text:
        text = _STRIKE.sub(lambda m: seen("markdown", m[1]), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: seen("html", html.unescape(m[0])) if html.unescape(m[0]) != m[0] else m[0], text)
    while kept and "\x00" in text:
        text = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
    return text


def _html_nodes(source: str, record: Record) -> None:
    """Nodes of a stretch with HTML block tags; text outside tags goes through the other notations."""
    stack: list[str] = []
    at = 0
    text: list[str] = []

    def flush() -> None:
        raw = "".join(text)
        text.clear()
        if not raw.strip():
            return
        path = "/".join(["body", *stack])
        block = next((t for t in reversed(stack) if t in BLOCK_TAGS), "")
        if not stack:
            _blocks(raw, record, False)
            return
        clean = re.sub(r"\s+", " ", _inline(raw, record)).strip()
        kind = "heading" + block[1] if re.fullmatch("h[1-6]", block) else {"li": "item", "td": "cell", "th": "cell", "tr": "cell"}.get(block, "text")
        if clean:
            record.nodes.append((path, kind, clean))

    pattern = re.compile(r"(?is)<pre(?:\s[^<>]*)?>(.*?)(?:</pre\s*>|\Z)|<(script|style)(?:\s[^<>]*)?>.*?</\2\s*>|" + _COMMENT.pattern + "|" + _TAG.pattern)
    for m in pattern.finditer(source):
        if m[2] is None and m[0][1] not in "!" and m[1] is None and (m[4] or "").lower() not in BLOCK_TAGS | {"td", "th", "tbody", "thead"}:
            continue  # inline tags stay in their run
        if m[1] is None and m[2] is None and m[0][1] != "!" and m[4].lower() not in ELEMENTS:
            continue
        text.append(source[at : m.start()])
        at = m.end()
        record.mark("html")
        if m[0][1] == "!":
            continue
        flush()
        if m[1] is not None:
            record.nodes.append(("/".join(["body", *stack, "pre"]), "code", html.unescape(_TAG.sub("", m[1])).strip("\n")))
        elif m[2] is None:
            name = m[4].lower()
            if m[3]:
                if name in stack:
                    while stack.pop() != name:
                        pass
                if name == "tr":
                    record.nodes.append(("/".join(["body", *stack, "tr"]), "row", ""))
            elif name not in VOID and not m[6]:
                if name in ("li", "p", "td", "th", "tr", "dt", "dd") and name in stack and not {"ul", "ol", "table"} & set(stack[stack.index(name) :]):
                    del stack[stack.index(name) :]
                stack.append(name)
    text.append(source[at:])
    flush()


_HTML_BLOCK = re.compile(r"(?i)</?(?:" + "|".join(sorted(BLOCK_TAGS | {"td", "th", "script", "style"}, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>")


def _blocks(text: str, record: Record, outer: bool = True) -> None:
    """Line-oriented blocks of Markdown, wiki and LaTeX."""
    lines = text.split("\n")
    n, i = len(lines), 0
    para: list[str] = []
    nodes = record.nodes

    def flush() -> None:
        if not para:
            return
        raw = "\n".join(para)
        para.clear()
        if outer and "<" in raw and _HTML_BLOCK.search(raw):
            _html_nodes(raw, record)
            return
        clean = _inline(raw, record).strip()
        for part in re.split(r"\n(?=- )", clean):
            if part.strip():
                item = part.startswith("- ") and not raw.startswith("- ")
                nodes.append(("body/ul/li" if item else "body/p", "item" if item else "text", part[2:].strip() if item else part.strip()))

    def until(stop: re.Pattern | str, start: int) -> int:
        k = start
        while k < n and not (stop in lines[k] if isinstance(stop, str) else stop.match(lines[k])):
            k += 1
        return k

    while i < n:
        line = lines[i]
        bare = line.strip()
        if not bare:
            flush()
            i += 1
            continue
        head = bare[0]
        if head in "`~" and (m := _FENCE.match(line)):
            flush()
            record.mark("markdown")
            end = until(re.compile(r" {0,3}" + re.escape(m[1][0]) + "{" + str(len(m[1])) + r",}\s*$"), i + 1)
            nodes.append(("body/pre/code", "code", "\n".join(lines[i + 1 : end])))
            i = end + 1
            continue
        if head == "\\" and ((m := _VERBATIM.match(bare)) or (f := _FORMULA_ENV.match(bare))):
            flush()
            record.mark("latex")
            stop = "\\end{" + (m[1] if m else f[1] + f[2]) + "}"
            end = until(stop, i)
            body = "\n".join(lines[i : end + 1])
            body = body[body.index("}") + 1 :].split(stop)[0].strip("\n")
            if m:
                body = re.sub(r"^\[[^\]\n]*\]|^\{[^}\n]*\}", "", body).strip("\n")
            nodes.append(("body/pre/code", "code", body) if m else ("body/math", "formula", body.strip()))
            i = end + 1
            continue
        if bare == "$$" or bare == "\\[":
            stop = "$$" if bare == "$$" else "\\]"
            end = next((k for k in range(i + 1, n) if lines[k].strip() == stop), None)
            if end is not None:
                flush()
                record.mark("latex")
                nodes.append(("body/math", "formula", "\n".join(lines[i + 1 : end]).strip()))
                i = end + 1
                continue
        if bare.startswith("{|"):
            flush()
            record.mark("wiki")
            end = until(re.compile(r"\s*\|\}"), i + 1)
            cells: list[str] = []
            for row in [*lines[i + 1 : end], "|-"]:
                row = row.strip()
                if row.startswith("|-"):
                    if cells:
                        nodes.append(("body/table/tr", "table", " | ".join(cells)))
                    cells = []
                elif row[:1] in "|!" and row:
                    cells += [_inline(c.strip(), record) for c in re.split(r"\|\||!!", row[1:])]
                elif cells:
                    cells[-1] += " " + _inline(row, record)
            i = end + 1
            continue
        if head == "<" and (m := re.match(r"(?i)<(pre|syntaxhighlight|source|nowiki)(?:\s[^<>]*)?>", bare)):
            flush()
            end = until(f"</{m[1]}", i)
            body = "\n".join(lines[i : end + 1])
            if m[1].lower() == "pre":
                _html_nodes(body, record)
            else:
                record.mark("wiki")
                nodes.append(("body/pre/code", "code", re.sub(r"(?is)^<[^>]*>|</[^>]*>\s*$", "", body).strip("\n")))
            i = end + 1
            continue
        if outer and "<" in line and re.search(r"(?i)<pre[\s>]", line):  # a listing that begins inside a line runs to its end tag
            flush()
            end = until(re.compile(r"(?i).*</pre\s*>"), i)
            _html_nodes("\n".join(lines[i : end + 1]), record)
            i = end + 1
            continue
        if line[0] == " " and not para and not _BULLET.match(line) and not _ORDERED.match(line):
            # A block whose lines all begin with a blank is preformatted: one blank in a wiki, four in Markdown.
            end = i
            while end < n and (lines[end][:1] == " "):
                end += 1
            nodes.append(("body/pre/code", "code", "\n".join(x[1:] for x in lines[i:end]).rstrip()))
            i = end
            continue
        if head == "#" and (m := _ATX.match(line)):
            flush()
            if len(m[1]) == 1:
                record.shared += 1
            else:
                record.mark("markdown")
            nodes.append((f"body/h{len(m[1])}", f"heading{len(m[1])}", _inline(re.sub(r"\s+#+\s*$", "", m[2]), record)))
            i += 1
            continue
        if head == "=" and (m := _WIKI_HEADING.match(bare)):
            flush()
            record.mark("wiki")
            nodes.append((f"body/h{len(m[1])}", f"heading{len(m[1])}", _inline(m[2], record)))
            i += 1
            continue
        if head in "=-" and para and (m := _SETEXT.match(line)) and len(m[1]) >= 2:
            record.mark("markdown")
            title = _inline("\n".join(para), record)
            para.clear()
            nodes.append(("body/h1" if head == "=" else "body/h2", "heading1" if head == "=" else "heading2", title))
            i += 1
            continue
        if head == "\\" and (m := re.match(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{", bare)):
            flush()
            record.mark("latex")
            level = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m[1]]
            nodes.append((f"body/h{level}", f"heading{level}", _inline("\\textbf{" + bare[m.end() :], record).strip()))
            i += 1
            continue
        if head == "|" and i + 1 < n and "|" in lines[i + 1] and _DELIMITER.match(lines[i + 1]):
            flush()
            record.mark("markdown")
            end = i
            while end < n and lines[end].strip().startswith("|"):
                if end != i + 1:
                    cells = [_inline(c.strip(), record) for c in lines[end].strip().strip("|").split("|")]
                    nodes.append(("body/table/tr", "table", " | ".join(cells)))
                end += 1
            i = end
            continue
        if head in "*#:;" and (m := _NESTED.match(bare)) and not bare.startswith(("**", "***")) or head in "*" and re.match(r"\*{2,}\s+\S", bare):
            flush()
            record.mark("wiki")
            nodes.append(("body/ul/li", "item", _inline(bare.lstrip("*#:; "), record)))
            i += 1
            continue
        if head in ":;" and (m := _DEFINITION.match(line)):
            flush()
            record.mark("wiki")
            nodes.append(("body/dl/dd", "text", _inline(m[2], record)))
            i += 1
            continue
        if m := _BULLET.match(line):
            flush()
            if m[2] == "*":
                record.shared += 1
            else:
                record.mark("markdown")
            nodes.append(("body/ul/li", "item", _inline(m[3], record)))
            i += 1
            continue
        if m := _ORDERED.match(line):
            flush()
            record.mark("markdown")
            nodes.append(("body/ol/li", "item", _inline(m[3], record)))
            i += 1
            continue
        if head == ">" and (m := _QUOTE.match(line)):
            flush()
            record.mark("markdown")
            nodes.append(("body/blockquote", "quote", _inline(m[1], record)))
            i += 1
            continue
        para.append(line)
        i += 1
    flush()


def parse(text: str) -> Record:
    """Nodes and markup of a text."""
    record = Record()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not _ANY.search(text):
        record.nodes = [("body/p", "text", p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]
        return record
    _blocks(text, record)
    return record


def ratios(nodes: list[tuple[str, str, str]], spread: float = 1.0) -> np.ndarray:
    """The fused tag-path ratio of each node.

    Text length and punctuation are summed per path and divided by the path's nodes; both are smoothed with a
    Gaussian along the sequence, scaled to their mean, and multiplied.
    """
    paths: dict[str, list[float]] = {}
    for path, _, text in nodes:
        entry = paths.setdefault(path, [0.0, 0.0, 0.0])
        entry[0] += len(text)
        entry[1] += len(re.findall(r"[.,;:!?…。]", text))
        entry[2] += 1
    length = np.array([paths[p][0] / paths[p][2] for p, _, _ in nodes])
    points = np.array([paths[p][1] / paths[p][2] for p, _, _ in nodes])
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / spread) ** 2)
    kernel /= kernel.sum()
    smooth = [np.convolve(np.pad(x, 2, "edge"), kernel, "valid") for x in (length, points)]
    return np.sqrt((smooth[0] / max(smooth[0].mean(), 1e-9)) * ((smooth[1] + 0.1) / max(smooth[1].mean() + 0.1, 1e-9)))


def content_nodes(nodes: list[tuple[str, str, str]], threshold: float = 0.1) -> list[tuple[str, str, str]]:
    """Nodes that are content: all but text of paths in page furniture, or whose fused ratio is under the threshold.

    Structure (headings, items, code, formulas, tables, quotes) is content unless it lies inside page furniture of low ratio. With
    fewer than eight nodes a ratio means nothing and only furniture is judged.
    """
    if not any(len(p.split("/")) > 2 or FURNITURE & set(p.split("/")) for p, _, _ in nodes):
        return nodes
    value = ratios(nodes)
    out = []
    for node, v in zip(nodes, value, strict=True):
        inside = bool(FURNITURE & set(node[0].split("/")))
        if inside and v < 1.0 or (len(nodes) >= 8 and v < threshold and node[1] == "text" and len(node[0].split("/")) > 2):
            continue
        out.append(node)
    return out


def render(nodes: list[tuple[str, str, str]]) -> str:
    """Plain text in one notation: ``# heading``, ``- item``, ``1. item``, fenced code, ``$$formula$$``, ``a | b`` rows."""
    out: list[str] = []
    cells: list[str] = []
    last = ""
    number = 0
    for path, kind, text in nodes:
        number = number + 1 if kind == "item" and path.endswith("/ol/li") else 0
        if kind == "cell":
            cells.append(text)
            continue
        if kind == "row":
            if cells:
                out.append(("\n" if last == "table" else "\n\n") + " | ".join(cells))
                cells, last = [], "table"
            continue
        block = {"item": f"{number}. {text}" if number else f"- {text}", "code": f"```\n{text}\n```", "formula": f"$$\n{text}\n$$", "quote": f"> {text}"}.get(kind) or (f"{'#' * int(kind[7:])} {text}" if kind.startswith("heading") else text)
        out.append(("\n" if kind == last and kind in ("item", "table", "quote") else "\n\n") + block)
        last = kind
    if cells:
        out.append("\n\n" + " | ".join(cells))
    return "".join(out).strip()


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup found); None stays None."""
    if text is None:
        return None, []
    record = parse(text)
    return render(content_nodes(record.nodes)), record.kinds()


def convert(records: DataFrame, with_text: bool = True) -> DataFrame:
    """(record_kind, record_id, text) to (record_kind, record_id, clean_text, markup array<string>, nodes int).

    Null texts give null text and no markup, empty ones the empty text. A text that is delivered twice is converted twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds, counts = [], [], []
            for text in batch.column(2).to_pylist():
                record = parse(text) if text else Record()
                kept = content_nodes(record.nodes)
                texts.append(None if text is None or not with_text else render(kept))
                kinds.append(record.kinds())
                counts.append(len(kept))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["record_kind", "record_id", "clean_text", "markup", "nodes"])

    source = records.select(F.col("record_kind").cast("string"), F.col("record_id").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(run, "record_kind string, record_id string, clean_text string, markup array<string>, nodes int")


def found(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, markup): one row per record and kind present."""
    rows = convert(records.where("record_id is not null and text is not null"), with_text=False)
    return rows.select("record_kind", "record_id", F.explode("markup").alias("markup")).distinct()
