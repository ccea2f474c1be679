"""Problem 10: records that are template leftovers or the answer of a server.

Placeholders are read with one grammar for each kind of delimiter. Inline code, fenced
blocks, control blocks and lines that explain a field count against it, and what is left
must be dense enough among the words seen to be the record's own names. Notices and filler text count only
if they make up the record.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("placeholder", "filler", "error_page", "script_notice")

#: Names of what a record says about itself.
_OF = r"(?:project|company|class|module|package|e?mail|user|file|function|service|component|plugin|app|application|repo|repository|product|organi[sz]ation|team|first|last|full|author|your|my)"
_WHAT = r"(?:name|address|author|authors|version|owner|title|description|summary|year|date|e?mail|licen[cs]e|maintainer|organi[sz]ation|company|project|homepage|website|url|username|details|copyright)"
FIELD = rf"(?:cookiecutter\.)?(?:{_OF}[ _\-]?)*{_WHAT}(?:[ _\-]here)?"

#: Delimiters of placeholders: opening, closing.
DELIMITERS = {
    "double brace": (r"(?<![$\{])\{\{ ?", r" ?\}\}"),
    "script tag": (r"<%=? ?", r" ?%>"),
    "dollar brace": (r"(?<!\$)\$\{", r"\}"),
    "brace": (r"(?<![$\{\w])\{", r"\}(?!\})"),
    "angle": (r"<(?!/)", r">"),
    "square": (r"(?<![\w\])])\[", r"\](?![\[(:])"),
    "guillemet": (r"«", r"»"),
    "percent": (r"%%", r"%%"),
    "at": (r"@@", r"@@"),
    "dollar": (r"\$\$", r"\$\$"),
    "question": (r"\?\?\?", r"\?\?\?"),
    "underscore": (r"(?<![A-Za-z0-9_])__", r"__(?![A-Za-z0-9_])"),
    "your": (r"\bYOUR_", r"_HERE\b"),
}
_GRAMMARS = {k: re.compile(f"{a}({FIELD}){b}", re.I) for k, (a, b) in DELIMITERS.items()}
#: Any of them: the cheap first look.
_ANY = re.compile(rf"(?:[\{{<\[«%@$?=]|__|YOUR_)[ ]?(?:{FIELD})(?:[ ]?[\}}>\]»%@$?]|__|_HERE)", re.I)

_FENCE = re.compile(r"^(```|~~~).*?^\1[ \t]*$", re.M | re.S)
_INLINE = re.compile(r"`[^`\n]{1,200}`")
#: Names a language gives to its own things, in those delimiters.
_DUNDER = re.compile(r"__(?:version|author|authors|title|description|license|email|copyright|name|date|url|summary|maintainer)__\s*=(?!=)|(?<=\.)__\w+__")
_OWN_NAMES = frozenset(("name", "file", "date", "doc"))
_TEMPLATE_PATH = re.compile(r"(?:^|/)(?:_?templates?|skeletons?|scaffold(?:ing)?s?|archetypes?|blueprints?)/|\.(?:j2|jinja2?|tmpl|tpl|template|mustache|hbs|handlebars|erb|ejs|liquid|twig|cookiecutter)$|(?:^|/)\{\{", re.I)
_CONTROL = re.compile(r"\{%-?\s*(?:for|if|block|macro|set|include|extends)\b|\{\{[#/^]|<%\s*(?:if|for|end)\b|^\s*\{\{-?\s*(?:range|with|if|end)\b", re.M)

_TAG = re.compile(r"<[^<>]{0,300}>")
#: A tag of any length, by the grammar of attributes; a comparison of two values in code is none.
_LONG_TAG = re.compile(r"""</?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?+>""")
#: What stands in markup and is not seen: how it ends, and the whole of it.
_UNSEEN = tuple((end, re.compile(whole, re.S | re.I)) for end, whole in (("-->", r"<!--.*?-->"), ("</script", r"<script\b.*?</script\s*>?"), ("</style", r"<style\b.*?</style\s*>?")))
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: The words of the usual dummy text.
_LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et
    dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
    irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
    culpa qui officia deserunt mollit anim id est laborum ornare lacus vivamus pharetra mattis blandit congue dapibus rutrum
    vestibulum pellentesque curabitur maecenas praesent suspendisse vitae mauris viverra tincidunt""".split()
)
#: Words that only dummy text uses so.
_DUMMY = re.compile(r"(?i)\b(?:asdf|qwer(?:ty)?|blah|bla|foo bar|lorem|dummy|sample|placeholder|filler|blindtext|faux texte|texte d.exemple|texto de (?:exemplo|ejemplo|prueba)|testo di prova|insert your|add your|your (?:text|content|paragraph)|text|content|paragraph|xxx+|lipsum)\b")

#: Letters of which at least one stands in any dummy text: the cheap first look.
_DUMMY_HINTS = ("lorem", "ipsum", "dolor", "amet", "elit", "vivamus", "asdf", "qwer", "blah", "bla ", "foo bar", "dummy", "sample", "placeholder", "filler", "blindtext", "faux texte", "texte d", "texto de", "testo di", "insert your", "add your", "your ", "text text", "content content", "paragraph", "xxx", "lipsum")

_CODE = r"(?:4\d\d|5\d\d)"
_REASON = r"(?:bad request|unauthori[sz]ed|authori[sz]ation required|payment required|forbidden|not found|method not allowed|request time-?out|gone|too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|no such (?:key|bucket|file))".replace(" ", r"\ ")
_ERROR = re.compile(
    rf"""(?ix)
    \b(?:http(?:/\d(?:\.\d)?)?\s+|error\s+|fehler\s+|erreur\s+|status\s+)?{_CODE}\b\W{{0,4}}\s*(?:error\W*)?{_REASON}
    | \b{_REASON}\b\W{{0,12}}(?:"?(?:status|code|error)"?\W{{0,5}})?{_CODE}\b
    | "(?:message|error|detail|reason)"\s*:\s*"(?:{_REASON}|[^"]{{0,40}}(?:rate\ limit|denied|exceeded|unavailable)[^"]{{0,60}})"
    | <code>\s*(?:[A-Z][a-z]+){{1,4}}\s*</code>\s*(?:<message>|<requestid>|<hostid>|<resource>)
    | \b(?:error|fehler|erreur|errore?|status|c[oó]digo)\s*:?\s*{_CODE}\b
    | \b(?:page|file|repository|resource|document|blob|object|site|url|link)\b[^.\n]{{0,50}}\b(?:not\ found|could\ not\ be\ found|cannot\ be\ found|has\ moved|never\ existed|does\ not\ exist|doesn.t\ exist|no\ longer\ (?:exists|available)|(?:is\ |temporarily\ )?unavailable)
    | \b(?:we\ (?:couldn.t|could\ not|can.t|cannot)\ find)\b[^.\n]{{0,50}}\b(?:page|file|resource|document)
    | \baccess\b[^.\n]{{0,50}}\b(?:denied|refused|blocked|forbidden)\b
    | \b(?:exceeded|reached)\b[^.\n]{{0,40}}\b(?:limit|quota)\b | \b(?:rate|download|request)\ limit\b[^.\n]{{0,30}}\b(?:exceeded|reached)
    | \bupstream\ (?:connect\ error|request\ timeout) | \bdisconnect\/reset\ before\ headers | \bconnection\ (?:refused|reset|timed\ out)\b
    | \b(?:try|come)\ (?:again|back)\ later\b | \bmaintenance\ window\b | \bdown\ for\ maintenance\b
    | \bseite\b[^.\n]{{0,40}}\bnicht\ (?:gefunden|verf[uü]gbar|erreichbar) | \bdatei\b[^.\n]{{0,40}}\bnicht\ gefunden | \bzugriff\b[^.\n]{{0,30}}\bverweigert
    | \bpage\b[^.\n]{{0,20}}\bintrouvable | \bfichier\ introuvable | \bacc[eè]s\ (?:refus[eé]|interdit) | \bp[aá]gina\ n(?:o|ã?ã?o)\b[^.\n]{{0,20}}\bencontrad | \bacceso\ denegado | \bacesso\ negado | \bpagina\ non\ trovata
    """
)
_SCRIPTS = r"(?:java\s?script|scripts?|scripting)"
_NOTICE = re.compile(
    rf"""(?ix)
    \b(?:enable|activate|turn\ on|allow|switch\ on|unblock|accept|permit)\b[^.\n]{{0,30}}\b{_SCRIPTS}\b
    | \b{_SCRIPTS}\b(?:\ and\ cookies)?[^.\n]{{0,25}}\b(?:required|disabled|turned\ off|must|needed|needs?\ to|necessary|blocked|not\ (?:enabled|supported|available))
    | \b(?:requires?|needs?|without)\b[^.\n]{{0,15}}\b{_SCRIPTS}\b
    | \b(?:checking|verifying|validating)\b[^.\n]{{0,20}}\b(?:your\ browser|you\ are\ (?:a\ )?human|connection)
    | \b(?:verify|prove|confirm)\b[^.\n]{{0,20}}\b(?:human|not\ a\ (?:ro)?bot)\b | \bjust\ a\ moment\b | \bcomplete\ the\ captcha\b
    | \bactive[rz]\b[^.\n]{{0,20}}\b{_SCRIPTS}\b | \b{_SCRIPTS}\b[^.\n]{{0,40}}\b(?:aktivier|einschalten|requis|d[eé]sactiv|necess[aá]ri|habilit|ativ) | \b(?:habilit|ativ|abilit|attiv)\w*\b[^.\n]{{0,20}}\bjava\s?script | \baktivieren\b[^.\n]{{0,20}}\b{_SCRIPTS}
    """
)

#: A notice or dummy text makes up a record only if hardly anything stands beside it: so many words are seen, of 40
#: characters on an average at most, as text without blanks (minified data, other scripts) is no single word.
NOTICE_WORDS = 60
#: A page may ask for scripts beside its content; then more words than these stand in its other parts.
BESIDE_WORDS = 30
_PART = re.compile(r"<[^<>]*>|\n")
FILLER_SHARE = 0.6
#: Fields must be dense enough to be the record's own names: several, and one in so many seen words, as a head of names
#: stands for a file of that length; a field alone must be nearly all there is.
LEAST_FIELDS, WORDS_A_FIELD, WORDS_ALONE = 2, 400, 8
#: A line that tells what becomes of a field names nothing by it.
_EXPLAINS = re.compile(r"\b(?:replac(?:e|es|ed|ing)|substitut\w+|interpolat\w+|placeholders?|expands? (?:to|into)|expanded|rendered|fills? in|filled in|for example|for instance|e\.g\.|such as|syntax|tutorial|docs?|documentation)\b", re.I)


def _own_text(text: str) -> str:
    """The text without fenced blocks and inline code, which explain rather than name."""
    return _INLINE.sub(" ", _FENCE.sub(" ", text)) if "`" in text or "~~~" in text else text


def _told(own: str, m: re.Match) -> bool:
    """Whether the line of a match explains the field."""
    begin, end = own.rfind("\n", 0, m.start()) + 1, own.find("\n", m.end())
    return bool(_EXPLAINS.search(own[begin : m.start()] + " " + own[m.end() : end if end >= 0 else len(own)]))


def _placeholder(text: str, path: str | None) -> bool:
    if not _ANY.search(text) or path and _TEMPLATE_PATH.search(path) or _CONTROL.search(text):
        return False
    own = _own_text(text)
    count = 0
    for kind, grammar in _GRAMMARS.items():
        found = list(grammar.finditer(own))
        if kind == "underscore" and found:
            found = [m for m in found if m.group(1) not in _OWN_NAMES]
            found = found[: max(0, len(found) - len(_DUNDER.findall(own)))]
        elif kind == "angle" and found:
            low = own.lower()
            found = [m for m in found if f"</{m.group(1).lower()}>" not in low]
        found = [m for m in found if not _told(own, m)]
        if not found:
            continue
        count = count or sum(1 for _ in _WORD.finditer(own))
        # one angle or pair of underscores alone is a language's own
        if count <= (WORDS_A_FIELD * len(found) if len(found) >= LEAST_FIELDS else 0 if kind in ("angle", "underscore") else WORDS_ALONE):
            return True
    return False


def _filler(text: str) -> bool:
    low = text.lower()
    if not any(hint in low for hint in _DUMMY_HINTS):
        return False
    body = _TAG.sub(" ", text)
    words = [w.lower() for w in _WORD.findall(body)]
    if len(words) < 8 or len(_TAG.findall(text)) > 12:
        return False
    if sum(w in _LOREM for w in words) >= max(6, FILLER_SHARE * len(words)) and len(set(words) & _LOREM) >= 4:
        return True
    if not _DUMMY.search(body):
        return False
    # one phrase again and again: the words repeat at a fixed distance
    for period in range(1, 9):
        if len(words) < 4 * period:
            break
        same = sum(a == b for a, b in zip(words, words[period:]))
        if same >= 0.8 * (len(words) - period - 3) and same >= FILLER_SHARE * len(words) and len(words) >= 4 * period:
            return True
    return False


def _is_code(text: str) -> bool:
    """Lines that define or call something: a file that tests or makes such a text."""
    return bool(re.search(r"(?m)^\s*(?:def|class|func|function|import|from|package|public|private|static|const|let|var|return|assert|#include|type|interface|select)\b|=>|^\s*[A-Za-z_]\w*\s*=\s*[\"'\[{(]|\)\s*[;{]\s*$", text))


def _seen(text: str) -> tuple[str, str]:
    """The text without scripts, styles and comments, and that without tags, whatever their length."""
    if "<" not in text:
        return text, text
    for end, whole in _UNSEEN:
        last = text.lower().rfind(end)
        if last >= 0:  # nothing is looked for behind the last end, so that each beginning finds one
            stop = last + len(end) + 1
            text = whole.sub(" ", text[:stop]) + text[stop:]
    return text, _TAG.sub(" ", _LONG_TAG.sub(" ", text))


def kinds_of(text: str | None, path: str | None = None) -> list[str]:
    """The kinds of residue that make up a record."""
    if not text or not text.strip():
        return []
    out = []
    if _placeholder(text, path):
        out.append("placeholder")
    if _filler(text):
        out.append("filler")
    markup, plain = _seen(text)
    words = plain.split()
    if len(words) <= NOTICE_WORDS and sum(map(len, words)) <= 40 * NOTICE_WORDS and not _is_code(plain):
        if _NOTICE.search(plain) and sum(len(part.split()) for part in _PART.split(markup) if not _NOTICE.search(part)) <= BESIDE_WORDS:
            out.append("script_notice")
        elif _ERROR.search(markup) or _ERROR.search(plain):
            out.append("error_page")
    return out


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "path") -> DataFrame:
    """One row (id, kind) for each kind of residue that makes up a record.

    Null, empty and blank texts have no kind. Repeated rows give one row. Without a path
    column only the text decides whether a file is kept as a template.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds = [], []
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for kind in kinds_of(text, path):
                    at.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(kinds, pa.string())], names=[id_col, "kind"])

    path = F.col(path_col).cast("string") if path_col and path_col in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col), F.col(text_col).cast("string"), path.alias("_path")).where(F.col(text_col).isNotNull()).mapInArrow(run, schema).distinct()


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "path") -> DataFrame:
    """The rows of ``df`` that are no residue, with all their columns."""
    return df.join(find_residue(df, id_col, text_col, path_col).select(id_col).distinct(), id_col, "left_anti")


def count_kinds(found: DataFrame) -> Counter:
    """Rows by kind, for reports."""
    return Counter({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()})
