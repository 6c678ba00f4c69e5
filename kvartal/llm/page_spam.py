"""Pages of repeated keywords, links or tags instead of sentences.

A page is cut into links, tags, lines of facts and stretches of text.  Each
stretch is judged as sentence or not by its share of function words, by its
separators, by how it ends, and by how far its words, and those around it,
repeat.  Over the whole page, the share of its top word, of n-grams seen before
and of duplicate lines tell whether it repeats; the stretches of a page that
does need more function words, and those with its top word are no sentences.
Short stretches that show neither function word nor predicate are no sentences
where they make up most of the page.  What counts as usual is measured on the
whole corpus for each language.  A page is named if links, tags and stretches
that are no sentences make up more than half of its letters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.sources.tables import stored

# Patterns of page parts.
LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])(?:[\w-]+\.)+[a-z]{2,12}/\S*", re.I)
ANCHOR = re.compile(r"<a\b[^<>]*+>((?:[^<]++|<(?!/?a\b))*+)</a\s*>", re.I)
MARKUP = re.compile(r"<[a-zA-Z/!?][^<>]*+>")
LETTERS = re.compile(r"[^\W_]+")
TAG = re.compile(r"#[\w-]+")
SENTENCE_GAP = re.compile(r'(?<=[.!?…])["»)\]]*\s+')
SENTENCE_END = re.compile(r'[\w»")\]%²][.!?]+["»)\]]*\s*\W{0,3}$')
SEPARATOR = re.compile(r"[,;|/•★·→*>~✅🔥:]|(?<=\s)[-–—](?=\s)")
FACT = re.compile(r"^\W{0,3}[^\W\d][\w .²]{0,28}:\s*\S(?:[^,;|•★·]|,(?=\d)){0,40}$")
NUMBER_CELL = re.compile(r"^\s*[\d.,\s]+\s*(?:m²|m2|₼|azn)?\s*$", re.I)
WORD = re.compile(r"[^\W\d_][\w'’]*")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
# Function words that join sentences and hardly occur in lists of keywords.
FUNCTION_WORDS = {
    "az": "amma artıq axı ayrı ən bəri bəzən bir bu bütün çox çünki da daha də edib edilib edir etdi görə halbuki hamısı heç hələ hər isə kimi ki lakin nə olub ona orada öz qədər son sonra üçün var və yalnız yoxdur",
    "en": "a although an and as at because been but by every for from had has have in into is it its not of on or over since than that the there this to was were which will with",
    "ru": "а в все всё вы для до ещё есть же за здесь и из или их как какой когда который мы на нам нас не нет но он она они от перед по после при с так там у уже хотя чтобы что это",
    "tr": "ama artık bazen bile bir boyunca bu çok çünkü da daha de değil en gibi göre her hiç için ilk ise kadar ki ne oldu olarak orada oysa önce sadece son sonra üzerinde var ve yılında zaten",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALL_WORDS = frozenset().union(*_WORDS.values())
_LANGUAGES = {w: [lang for lang, f in _WORDS.items() if w in f] for w in _ALL_WORDS}
# Endings of predicates, in the Turkic languages where a clause ends, in Russian anywhere.
PREDICATE = re.compile(
    r"(?:\w{2}(?:[dt][ıiuü]r|[ıiuü]r|yor|[dt][ıiuü]|[ıiuü]b|m[ıiuü]ş|[ae]c[ae]k|acaq|əcək)(?:l[aəe]r)?|\b(?:bilər|bilmər|olar|olmaz|yox|değil))[»\")\]]*\s*[,;:.!?…]"
    r"|\w{2}(?:[аяеую]ет|[аяую]ют|[аеу]ёт|[еёия]тся|[ую]тся|[аяиеы]л(?:ся|[аои]сь))\b|\w{3}(?:[аяиы]ли|[аяиы]ло)\b",
    re.I,
)
#: Words up to which an ended stretch may do without function words.
SHORT_WORDS = 20
#: Words after which a stretch is compared for repetition together with its neighbours.
WINDOW_WORDS = 40
#: Multiples of the usual figures of a language: share of function words, separators a word, distinct words in a stretch and in a window.
FACTORS = {"fw": 0.25, "sep": 2.7, "distinct": 0.85, "window": 0.65}
#: Figures taken where a language has fewer than LEAST sentences.
USUAL = {"fw": 0.2, "sep": 0.125, "distinct": 0.89, "window": 0.77}
LEAST = 200
#: Measured figures count within these, so that a language of mostly keywords isn't its own measure; that of function words only where they are listed.
BOUNDS = {"fw": (0.1, 0.5), "sep": (0.08, 0.2), "distinct": (0.8, 1.0), "window": (0.65, 0.85)}
#: Multiples of the usual shares of a page of sentences (its top word, n-grams seen before, duplicate lines), and the least limits.
PAGE_FACTORS = {"top": 2.5, "gram": 2.0, "dup": 2.0}
PAGE_FLOORS = {"top": 0.08, "gram": 0.3, "dup": 0.2}
#: Shares taken where a language has fewer than LEAST pages of sentences.
PAGE_USUAL = {"top": 0.04, "gram": 0.2, "dup": 0.0}
#: Words of an n-gram, and words from which a page has the three shares.
GRAM, PAGE_WORDS = 3, 30
#: Times from which a word can be a top word.
TOP_TIMES = 5
#: Times the least share of function words that the stretches of a repeating page need.
REPEATING = 2.0
SCHEMA = "doc long, lang string, top double, gram double, dup double, parts array<struct<kind: string, n: int, words: int, fw: double, sep: double, distinct: double, ends: boolean, shouts: boolean, even: boolean, window: double, says: boolean, top: boolean>>"
_PART = pa.struct([("kind", pa.string()), ("n", pa.int32()), ("words", pa.int32()), ("fw", pa.float64()), ("sep", pa.float64()), ("distinct", pa.float64()), ("ends", pa.bool_()), ("shouts", pa.bool_()), ("even", pa.bool_()), ("window", pa.float64()), ("says", pa.bool_()), ("top", pa.bool_())])


def _letters(text: str) -> int:
    return sum(map(len, LETTERS.findall(text)))


def _lower(text: str) -> str:
    return text.replace("İ", "i").lower()


def _part(kind, n, words=1, fw=0.0, sep=0.0, distinct=1.0, ends=False, shouts=False, even=False, window=1.0, says=False, top=False):
    return {"kind": kind, "n": n, "words": words, "fw": fw, "sep": sep, "distinct": distinct, "ends": ends, "shouts": shouts, "even": even, "window": window, "says": says, "top": top}


def _is_row(line: str) -> bool:
    """A line of a table: a few cells of which two or more are figures."""
    if "|" not in line and "\t" not in line:
        return False
    cells = re.split(r"[|\t]", line.strip().strip("|"))
    return 3 <= len(cells) <= 8 and sum(bool(NUMBER_CELL.match(c)) for c in cells) >= 2


def page_shares(lines: list[tuple[str, int]], stretches: list[tuple[dict, list[str]]]) -> dict[str, float]:
    """Shares of a page's text: its top word, n-grams seen before, letters of duplicate lines; marks the stretches with the top word."""
    words = [x for _, ws in stretches for x in ws]
    if len(words) < PAGE_WORDS:
        return {"top": 0.0, "gram": 0.0, "dup": 0.0}
    counts = Counter([x for x in words if len(x) > 2 and x not in _ALL_WORDS])
    word, most = max(counts.items(), key=lambda t: (t[1], t[0]), default=("", 0))
    for p, ws in stretches:
        p["top"] = word in ws
    grams = list(zip(*(words[i:] for i in range(GRAM))))
    seen, again = set(), 0
    for line, n in lines:
        again += n if line in seen else 0
        seen.add(line)
    return {"top": most / len(words) if most >= TOP_TIMES else 0.0, "gram": 1 - len(set(grams)) / len(grams), "dup": again / sum(n for _, n in lines)}


def page_parts(text: str) -> tuple[str, list[dict], dict[str, float]]:
    """Language by function words ('' if they show none), the parts of a page, and its page_shares."""
    text = html.unescape(text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = INVISIBLE.sub("", text)
    parts, hits, near, near_words = [], dict.fromkeys(_WORDS, 0), [], []
    lines, stretches = [], []

    def close():
        if near:
            words = [x for ws in near_words for x in ws]
            ratio = len(set(words)) / len(words) if len(words) >= 12 else 1.0
            for p in near:
                p["window"] = ratio
            near.clear()
            near_words.clear()

    if "<" in text:
        linked = sum(_letters(MARKUP.sub("", m)) for m in ANCHOR.findall(text))
        if linked:
            parts.append(_part("link", linked))
            text = ANCHOR.sub("\n", text)
        text = MARKUP.sub("\n", text)
    for line in re.split(r"[\r\n]+", text):
        links, tags, rest = [], [], line
        if "/" in line or "www." in line.lower():
            links = LINK.findall(line)
            rest = LINK.sub(" ", line)
        if "#" in rest:
            tags = TAG.findall(rest)
            rest = TAG.sub(" ", rest)
        for kind, found in (("link", links), ("tag", tags)):
            if n := sum(map(_letters, found)):
                parts.append(_part(kind, n, len(found)))
        if not (n := _letters(rest)):
            continue
        if not links and not tags and (FACT.match(line) or _is_row(line)):
            parts.append(_part("fact", n))
            continue
        lines.append((" ".join(_lower(rest).split()), n))
        for stretch in SENTENCE_GAP.split(rest):
            if not (n := _letters(stretch)):
                continue
            words = WORD.findall(_lower(stretch))
            k = max(1, len(words))
            own = dict.fromkeys(_WORDS, 0)
            for x in [x for x in words if x in _LANGUAGES]:
                for lang in _LANGUAGES[x]:
                    own[lang] += 1
            for lang, c in own.items():
                hits[lang] += c
            end = SENTENCE_END.search(stretch)
            fw = max(own.values()) / k
            shouts = even = says = False
            if end and "!" in end.group(0):
                # Whether it is written evenly, and below whether it has a predicate, is looked up only where it can matter.
                raw = WORD.findall(stretch)
                capitals = 0 if stretch.upper() == stretch else sum(x[0].isupper() for x in raw[1:])
                shouts, even = True, bool(raw) and (raw[0][0].isupper() or stretch.strip()[:1].isdigit()) and capitals <= 2
            if end and len(words) <= SHORT_WORDS and fw < FACTORS["fw"]:
                says = bool(PREDICATE.search(stretch))
            p = _part("text", n, len(words), fw, len(SEPARATOR.findall(stretch)) / k, len(set(words)) / k, bool(end), shouts, even, says=says)
            parts.append(p)
            stretches.append((p, words))
            near.append(p)
            near_words.append(words)
            if sum(map(len, near_words)) >= WINDOW_WORDS:
                close()
    close()
    best = max(hits, key=hits.get)
    return (best if hits[best] else ""), parts, page_shares(lines, stretches)


def _read(batches):
    for batch in batches:
        langs, parts, shares = [], [], {c: [] for c in PAGE_USUAL}
        for text, said in zip(batch.column("text").to_pylist(), batch.column("said").to_pylist()):
            lang, p, s = page_parts(text)
            langs.append(lang or said)
            parts.append(p)
            for c, v in s.items():
                shares[c].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(langs, pa.string()), *[pa.array(v, pa.float64()) for v in shares.values()], pa.array(parts, type=pa.list_(_PART))], names=["doc", "lang", *shares, "parts"])


def _listed(lang: Column) -> Column:
    """Whether a text of the language would show its function words; one without any language counts."""
    return lang.isin("", *FUNCTION_WORDS)


def usual_figures(pages: DataFrame) -> DataFrame:
    """For each language, over all stretches of the corpus that end like sentences: the figures that FACTORS multiplies."""
    p = pages.select("lang", F.explode("parts").alias("p")).where("p.kind = 'text' and p.ends and p.words >= 8")
    figures = p.groupBy("lang").agg(
        F.count("*").alias("stretches"), F.percentile_approx("p.fw", 0.5, 1000).alias("fw"), F.percentile_approx("p.sep", 0.9, 1000).alias("sep"),
        F.percentile_approx("p.distinct", 0.1, 1000).alias("distinct"), F.percentile_approx("p.window", 0.1, 1000).alias("window"),
    )
    bound = {c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)) for c, (low, high) in BOUNDS.items()}
    bound["fw"] = F.when(_listed(F.col("lang")), bound["fw"]).otherwise(F.col("fw"))
    return figures.select("lang", *[F.when(F.col("stretches") >= LEAST, bound[c]).otherwise(F.lit(v)).alias("usual_" + c) for c, v in USUAL.items()])


def usual_shares(pages: DataFrame) -> DataFrame:
    """For each language, over the pages most of whose letters are in stretches that end like sentences: the shares that PAGE_FACTORS multiplies."""
    number = lambda test: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(test(p), p["n"]).otherwise(0))
    whole = pages.where(number(lambda p: p["ends"] & (p["words"] >= 8)) * 2 > number(lambda p: F.lit(True)))
    shares = whole.groupBy("lang").agg(F.count("*").alias("whole"), *[F.percentile_approx(c, 0.9, 1000).alias(c) for c in PAGE_USUAL])
    return shares.select("lang", *[F.when(F.col("whole") >= LEAST, F.col(c)).otherwise(F.lit(v)).alias("usual_" + c) for c, v in PAGE_USUAL.items()])


def _is_sentence(p: Column, limits: dict[str, Column]) -> Column:
    repeats = ((p["words"] >= 6) & (p["distinct"] < limits["distinct"])) | (p["window"] < limits["window"]) | (F.col("tops") & p["top"])
    short = (p["words"] <= SHORT_WORDS) & (~p["shouts"] | p["even"]) & ~F.col("repeating")
    whole = p["ends"] & ((p["fw"] >= limits["fw"] * F.when(F.col("repeating"), REPEATING).otherwise(1.0)) | (short & (p["says"] | ~F.col("bare"))))
    cut = ~p["ends"] & (p["words"] >= 5) & (p["fw"] >= 1.6 * limits["fw"])
    return (p["kind"] == "text") & (p["words"] >= 4) & ~repeats & (p["sep"] <= limits["sep"]) & (whole | cut)


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(``doc_id``, spam_share, page_lang) of pages more than half of whose letters are keywords, links or tags.

    NULL, empty and blank texts, and texts without a letter or digit, are no
    cases.  Long texts are judged whole; copies are judged alike.  ``lang``
    counts only where a text shows no function word; NULL there is a language
    of its own.  ``doc_id`` is a whole number; repeated ids give repeated rows.
    """
    said = F.coalesce(F.substring(F.lower(lang), 1, 2), F.lit(""))
    pages = stored(docs.where(F.length(F.trim(text)) > 0).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), said.alias("said")).mapInArrow(_read, SCHEMA), "pages")
    figures = usual_figures(pages).join(usual_shares(pages), "lang", "full")
    limits = {c: F.col("usual_" + c) * f for c, f in FACTORS.items()}
    number = lambda test: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(test(p), p["n"]).otherwise(0))
    judged = pages.join(F.broadcast(figures), "lang", "left")  # one row per language that function words or two letters name
    judged = judged.select("doc", "lang", "parts", *PAGE_USUAL, *[F.coalesce("usual_" + c, F.lit(v)).alias("usual_" + c) for c, v in {**USUAL, **PAGE_USUAL}.items()])
    beyond = {c: F.col(c) > F.greatest(F.lit(PAGE_FLOORS[c]), F.col("usual_" + c) * f) for c, f in PAGE_FACTORS.items()}
    total = number(lambda p: F.lit(True))
    bare = number(lambda p: (p["kind"] == "text") & p["ends"] & (p["words"] >= 4) & (p["words"] <= SHORT_WORDS) & (p["fw"] < limits["fw"]) & ~p["says"])
    judged = judged.select("*", beyond["top"].alias("tops"), (beyond["gram"] | beyond["dup"]).alias("repeating"), (_listed(F.col("lang")) & (2 * bare > total)).alias("bare"))
    fair = number(lambda p: (p["kind"] == "fact") | _is_sentence(p, limits))
    share = judged.select("doc", "lang", total.alias("total"), fair.alias("fair")).where("total > 0").select(F.col("doc").alias(doc_id), (1 - F.col("fair") / F.col("total")).alias("spam_share"), F.col("lang").alias("page_lang"))
    return share.where("spam_share > 0.5")
