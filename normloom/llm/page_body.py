"""The body of a page whose text carries the site's frame, by composite text density.

A page is text, one block per line.  It is read as a tree: the page, its modules,
their lines.  Modules end where navigation, a breadcrumb or a list of teasers
stands; lines of the page system (consent, sharing, dates, advertisements) may lie
inside a module without ending it.  Every node has characters C, tags T, link
characters LC and link tags LT; a separated menu has one link a label, a teaser or
a prompt is a link as a whole.  The composite density of a node is

    C / T * log_b( C/LC * T/LT ),   b = ln( C/(C-LC) * LC + LC_page/C_page * C + e )

(one is added to counts that may be zero), a module's sum is that of its lines'
densities.  The module with the largest sum is the body; the least density on its
path to the page is the threshold that other modules must reach to belong to it.
The title, found by the breadcrumb's last entry or as the heading of the first
module, stays.  All other lines, and the frame lines inside the body, are frame.

Frame lines are told by the site itself: a line (digits aside) that stands on at least
``LEAST_PAGES`` of a site's pages and on the share ``SITE_SHARE`` of them belongs to its
frame in whatever language, unless it stands inside the page's own lines as a heading.  The
counts are over all pages.  Lines that a site writes anew for each page (teasers,
breadcrumbs, prompts with the page's topic) are told by form (separators, "read more",
dates in brackets), by fixed phrase patterns in English, German and French and by a
vocabulary of navigation labels; whole sentences that merely mention cookies or
newsletters are body.

Null and empty pages have no lines; blank lines have no class but count in the
numbering; a page without any frame comes out whole.  Pages without a site are told by
form and phrases alone.  Rows with a null id are left out, repeated rows give repeated
lines, extra columns are ignored.  Pages are read whole, one at a time; what is shuffled
is a hash a line for the counts, summed where it lies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.tables import cut

#: On how many pages, and on what share of its site's pages, a line is one of the frame.
LEAST_PAGES, SITE_SHARE = 5, 0.3
#: Keys of repeated lines that may be broadcast, some tens of MB; more are joined.
BROADCAST_KEYS = 2_000_000
RESULT = "chunk_idx bigint, line_no int, is_frame boolean, line string"

# Labels of site navigation, in English, German and French.
NAVIGATION = {
    "en": "home|menu|search|contact|contact us|about|about us|news|newsroom|press|press corner|press releases|media|blog|events|events calendar|calendar|publications|library|legislation|glossary|topics|tools|forum|funding|careers|jobs|vacancies|shop|store|cart|site map|sitemap|data room|members area|members|open calls|calls|webinars|accessibility|log in|login|sign in|sign up|register|log out|my account|account|help|faq|support|services|products|projects|partners|team|our team|downloads|resources|archive|subscribe|newsletter|language|languages|language: en|language: de|language: fr|en|de|fr|follow us|feedback|donate|links|imprint|privacy|privacy policy|terms of use|terms|legal notice|cookie settings|cookie policy|accessibility statement|disclaimer|copyright|skip to content|skip to main content|toggle navigation|close|back|next|previous|more|all topics|policies|statistics|training|videos|podcast|podcasts|gallery|directory|documents",
    "de": "startseite|start|menü|suche|kontakt|über uns|aktuelles|nachrichten|presse|veranstaltungen|termine|publikationen|bibliothek|gesetze|glossar|themen|werkzeuge|forum|förderung|karriere|stellenangebote|shop|sitemap|datenraum|mitgliederbereich|ausschreibungen|webinare|barrierefreiheit|anmelden|abmelden|registrieren|hilfe|impressum|datenschutz|nutzungsbedingungen|agb|sprache|sprache: de",
    "fr": "accueil|menu|recherche|rechercher|contact|à propos|qui sommes-nous|actualités|presse|espace presse|événements|agenda|publications|bibliothèque|législation|glossaire|thèmes|outils|forum|financement|carrières|emplois|boutique|plan du site|espace membres|appels|webinaires|accessibilité|connexion|se connecter|s'inscrire|aide|mentions légales|confidentialité|conditions d'utilisation|langue|langue: fr",
}
LABELS = frozenset(x for labels in NAVIGATION.values() for x in labels.split("|"))

# Phrases of site frames.
CONSENT = (
    r"\b(?:we|our|us|you|your|this (?:web)?site|this page|wir|unsere?|diese (?:website|webseite|seite)|nous|notre|ce site|cette page)\b.*\b(?:cookies?|tracking technolog\w+|local storage|small text files|similar technologies|consent|traceurs?)\b",
    r"\b(?:cookies?|tracking technolog\w+|local storage|small text files|similar technologies)\b.*\b(?:we|our|you|your|others are optional|wir|sie können|nous|vous|manage preferences|accept all)\b",
    r"^(?:some|certain) (?:functional and analytical cookies|tracking technologies|local storage|small text files|cookies|similar technologies|cookies and similar technologies)\b.*\b(?:needed|necessary|required|optional)\b",
    r"\b(?:see|read) (?:our|more about|the) (?:cookie|privacy|how we)",
    r"^you can (?:change|withdraw) your (?:choice|consent|settings)",
    r"^your privacy\b",
    r"^by (?:continuing|using|browsing|clicking)\b.*\byou\b",
    r"^(?:(?:accept|reject|allow|decline|manage|save|confirm)(?: all| preferences| selection| choices| settings| cookies)?|settings|preferences)(?:\W+(?:accept|reject|allow|decline|manage|settings|preferences|all|selection|choices|cookies|save|confirm))*\W*$",
    r"^(?:alle(?:s)? (?:akzeptieren|ablehnen)|akzeptieren|ablehnen|einstellungen(?: verwalten)?|auswahl speichern|zustimmen)(?:\W+(?:alle|akzeptieren|ablehnen|einstellungen|verwalten))*\W*$",
    r"^(?:tout (?:accepter|refuser)|accepter|refuser|gérer mes choix|paramétrer|personnaliser)(?:\W+(?:tout|accepter|refuser|gérer|mes|choix))*\W*$",
    r"^(?:wir verwenden|diese website (?:speichert|verwendet)|nous utilisons|ce site (?:dépose|utilise)).*\bcookies\b",
)
FOOTER = (
    r"^(?:©|\(c\)|copyright\b|all rights reserved)",
    r"©.*\b\d{4}\b",
    r"^all rights reserved\W*$|\. all rights reserved\.?$",
    r"^powered by\b",
    r"\beditorial system\b",
    r"^(?:back to|return to) (?:the )?top$|^(?:nach oben|zum seitenanfang|haut de page|retour en haut)$",
    r"^follow us\b|^folgen sie uns|^suivez-nous",
    r"^call our (?:helpdesk|hotline|service)|^(?:our )?(?:helpdesk|hotline)\b.*\d",
    r"\bnot responsible for the content\b",
    r"^content on this (?:page|site)\b.*\b(?:information only|legal advice)",
    r"^(?:the )?information (?:on|in) this (?:page|site)\b.*\b(?:purposes only|legal advice)",
    r"\bdoes not constitute legal advice\b",
    r",\s*(?:postbox|p\.?\s?o\.? box|postfach|boîte postale|b\.?p\.?)\s*\d+",
    r"^(?:imprint|impressum|mentions légales|legal notice|privacy|terms of use|cookie settings)\b.{0,3}(?:[|·•/]|$)",
    r"^alle rechte vorbehalten|^tous droits réservés",
)
PROMPT = (
    r"^share (?:this|on)\b|^share\W*$|^(?:diese )?seite teilen|^partager\b|^teilen\W*$",
    r"^(?:print|download|save|bookmark|e-?mail|send) (?:this|as|the page|page|pdf)\b|^(?:drucken|imprimer)\b",
    r"^did you find this\b|^was this page\b|^is this page\b|^rate this page",
    r"^subscribe (?:to|now|today|for (?:our|free))\b|^subscribe\W*$|^sign up (?:for|to)\b|^register now\b|^get (?:the|our) .*\b(?:digest|newsletter|inbox|updates|alerts)\b|\benter your e-?mail",
    r"^join (?:our|us)\b|^stay (?:informed|up to date)",
    r"^enjoying this (?:page|article)",
    r"^tell us what you think",
    r"^(?:upcoming|next|free) (?:webinar|event|workshop)s?:|, register now$",
    r"^(?:advertisement|sponsored|anzeige|publicité|werbung)\b(?:\W|$)",
    r"^article continues\b|^continue reading|^weiterlesen|^lire la suite",
    r"^(?:read|see) also:|^lire aussi|^siehe auch:",
    r"^(?:popular|related|trending) (?:tags|topics|searches):|^tags?:|^schlagwörter:|^mots[- ]clés",
    r"^newsletter abonnieren|^abonnez-vous|^leave a comment|^post a comment|^log in to comment",
)
SYSTEM = (
    r"^(?:last )?(?:updated|modified|reviewed|changed)\b.*\d|^page (?:reviewed|updated|last)\b.*\d|^(?:published|posted) (?:on|by|at)?\b.*\d{4}",
    r"^reading time\b|\b\d+ min(?:utes?)? read\b|\blisten to this page\b|^lesezeit|^temps de lecture",
    r"^[\d.,]+\s*(?:views|comments|shares|likes|reads|downloads)\b",
    r"^(?:aktualisiert|stand|zuletzt geändert|mis à jour|dernière mise à jour)\b.*\d",
    r"^page \d+ of \d+$",
)
TEASER_HEADS = frozenset("related articles|related pages|related content|related links|related news|related topics|you may also like|you might also like|most read|most popular|most viewed|latest news|latest articles|recent posts|recent articles|read next|further reading|more on this topic|more news|trending|trending now|recommended for you|recommended|editor's picks|in this section|see also|mehr zum thema|meistgelesen|das könnte sie auch interessieren|à lire aussi|articles liés|les plus lus|sur le même sujet".split("|"))
TEASER = (r"(?:–|-|—|…|\.\.\.)\s*(?:read|learn|see|find out|show) more\W*$|\b(?:read more|mehr lesen|weiterlesen|lire la suite)\s*[»>›→]?$", r"\((?:subscribers|members) only\)\W*$")

_I = re.IGNORECASE


def _alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives at the outer level."""
    out, depth, klass, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        klass = c == "[" or (klass and c != "]")
        depth += {"(": 1, ")": -1}.get(c, 0) if not klass else 0
        if c == "|" and not depth and not klass:
            out.append("")
        else:
            out[-1] += c
        i += len(c)
    return out


_FRAME = [a for p in (*CONSENT, *FOOTER, *PROMPT, *SYSTEM) for a in _alternatives(p)]
#: All frame patterns, over lower-case text: those that begin a line, and the others, which
#: need one of the words below.
_BEGINS = re.compile("|".join(a[1:] for a in _FRAME if a[0] == "^"))
_HOLDS = re.compile("|".join(a for a in _FRAME if a[0] != "^"))
_HOLDS_WORDS = (
    "cookie", "tracking", "local storage", "text files", "technolog", "consent", "traceur", "privacy", "©", "rights reserved", "editorial system", "responsible for", "legal advice", "box", "postfach",
    "boîte postale", "b.p", "bp", "enter your", "register now", "listen to this", " min", "how we",
)
#: Every teaser pattern needs one of these.
_TEASER_WORDS = ("more", "mehr", "weiter", "suite", "only")
_TEASER = re.compile("|".join(TEASER))
_MARKER = re.compile(r"^\s*(?:[*•·▪◦‣–—-]\s+|[☰≡]\s*|\(?(?:\d{1,2}|[a-z])\)\s+)", _I)
_TEASER_MARKER = re.compile(r"^\s*(?:[>»›→]\s+|\d{1,2}\.\s+)")
_DATED = re.compile(r"\(\d{1,2}\.? [^\W\d_]{3,}(?: \d{4})?\)\s*$")
_SEPARATOR = re.compile(r"\s*[|·•/›»>]\s*|\s{2,}")
_CRUMB = re.compile(r"\s+[>›»/]\s+")
_SENTENCE_END = re.compile(r"[.!?:;][\"”’»)]?\s*$")


def _labels_only(text: str) -> bool:
    """Whether the text is a row of navigation labels, with or without separators."""
    words = text.lower().split()
    parted = any(c in text for c in "|·•/›»>") or len(" ".join(words)) != len(text)
    parts = [p for p in _SEPARATOR.split(text.lower()) if p] if parted else ()
    if len(parts) > 1:
        return sum(p in LABELS for p in parts) * 2 >= len(parts) and all(len(p) <= 40 for p in parts)
    i = n = 0
    while i < len(words):
        for k in (4, 3, 2, 1):
            if " ".join(words[i : i + k]) in LABELS and i + k <= len(words):
                i += k
                n += 1
                break
        else:
            return False
    return n > 0


@lru_cache(maxsize=200_000)
def classify(text: str) -> str:
    """The class of one line by itself; ``text`` is stripped."""
    bare = _MARKER.sub("", text).strip()
    low = bare.lower().rstrip(":").strip()
    if low in TEASER_HEADS:
        return "teaser head"
    if (steps := _CRUMB.split(text) if any(c in text for c in ">›»/") else ()) and len(steps) >= 3 and (steps[0].lower() in LABELS or len(steps) >= 4) and not _SENTENCE_END.search(text[:-1]):
        return "crumb"
    if _labels_only(bare):
        return "label" if bare.lower() in LABELS else "labels"
    low = bare.lower()
    if _BEGINS.match(low) or (any(w in low for w in _HOLDS_WORDS) and _HOLDS.search(low)):
        return "frame"
    whole = text.lower()
    if any(w in whole for w in _TEASER_WORDS) and _TEASER.search(whole):
        return "teaser"
    words = len(text.split())
    if (_SENTENCE_END.search(text[-2:]) and words >= 5) or len(text) > 110:
        return "prose"
    if _MARKER.match(text):
        return "item"
    if text[-1] == ")" and _DATED.search(text):
        return "teaser"
    if text[0] in ">»›→":
        return "teaser"
    return "numbered" if _TEASER_MARKER.match(text) else "short"


FRAME = frozenset(("teaser head", "crumb", "label", "labels", "frame", "teaser"))
#: Frame lines at which a module ends.
BOUNDARY = frozenset(("teaser head", "crumb", "labels", "teaser"))


def density(chars: float, tags: float, link_chars: float, link_tags: float, page_chars: float, page_links: float) -> float:
    """Composite text density of a node."""
    if chars <= 0:
        return 0.0
    base = math.log(chars / max(1.0, chars - link_chars) * link_chars + page_links / max(1.0, page_chars) * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / max(1.0, link_chars) * tags / max(1.0, link_tags)) + 1e-9) / max(math.log(base + 1e-9) if base > math.e else 1.0, 1.0)


def frame_of_page(text: str, repeated: Sequence[bool] | None = None) -> tuple[list[tuple[int, str]], set[int]]:
    """(number, line) of the non-blank lines and the numbers of those of the frame;
    ``repeated`` says of each line, blank ones included, whether its site repeats it."""
    lines = [(i, s) for i, s in enumerate(text.split("\n"), 1) if s.strip()]
    kinds = [classify(s.strip()) for _, s in lines]
    n = len(lines)
    if not n:
        return lines, set()
    texts = [s.strip() for _, s in lines]
    if repeated is not None:
        again = [bool(repeated[no - 1]) for no, _ in lines]
        begun = False  # whether a line of the page's own came before
        for i, k in enumerate(kinds):
            heads = begun and k == "short" and i + 1 < n and not again[i + 1] and kinds[i + 1] in ("prose", "item", "short", "numbered")
            if again[i] and k not in FRAME and not heads:
                kinds[i] = "frame"
            begun = begun or (k not in FRAME and not again[i])
    title = _title(texts, kinds)
    for i, k in enumerate(kinds):  # a lone label inside the body may be a heading
        if k == "label" and i > title >= 0:
            around = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < n]
            if all(a in ("prose", "item", "short", "numbered") for a in around):
                kinds[i] = "short"
    _mark_teasers(texts, kinds, title)

    # the tree: modules of lines, their sums of densities, the threshold on the path
    modules: list[list[int]] = [[]]
    for i, k in enumerate(kinds):
        if k in BOUNDARY or (k == "label" and i < title):
            modules.append([])
        else:
            modules[-1].append(i)
    modules = [m for m in modules if any(kinds[i] not in FRAME for i in m)]
    if not modules:
        return lines, {no for no, _ in lines}
    size = [len(t) for t in texts]
    links = [len(t) if k in FRAME else 0 for t, k in zip(texts, kinds)]
    tags = [max(1, len([p for p in _SEPARATOR.split(t) if p])) if k in ("labels", "crumb") else 1 for t, k in zip(texts, kinds)]
    page_chars, page_links = float(sum(size)), float(sum(links))

    def node(members: list[int]) -> float:
        return density(sum(size[i] for i in members), sum(tags[i] for i in members) + 1, sum(links[i] for i in members), sum(tags[i] for i in members if links[i]), page_chars, page_links)

    sums = [sum(node([i]) for i in m if not links[i]) for m in modules]
    best = max(range(len(modules)), key=sums.__getitem__)
    threshold = min(node(modules[best]), node(list(range(n))))
    body: set[int] = set()
    for k, m in enumerate(modules):
        some = [i for i in m if kinds[i] not in FRAME]
        rich = any(kinds[i] in ("prose", "item") for i in some)
        if k == best or (rich and node(some) >= threshold):
            body.update(some)
    body.update({title} if title >= 0 else ())
    return lines, {lines[i][0] for i in range(n) if i not in body}


def _title(texts: list[str], kinds: list[str]) -> int:
    """The title's index, or -1: the line that the breadcrumb ends in, else the first
    heading that no teaser list holds."""
    n = len(texts)
    for i, k in enumerate(kinds):
        if k == "crumb":
            last = _CRUMB.split(texts[i])[-1].rstrip(" .…").lower()
            for j in range(i + 1, n):
                if len(last) >= 3 and texts[j].lower().startswith(last) and kinds[j] != "crumb":
                    kinds[j] = "short"
                    return j
    first = next((i for i, k in enumerate(kinds) if k in ("prose", "item")), n)
    plain = [i for i in range(first) if kinds[i] == "short"]
    if not plain:
        return -1
    heads = [i for i in range(first) if kinds[i] in ("teaser head", "teaser")]
    after = [i for i in plain if not heads or i > heads[-1]]
    if heads and after:
        # teasers and the title follow one another: the title comes last before the body,
        # or stands behind another line of the frame
        broken = [i for i in after if any(kinds[j] in ("frame", "labels") for j in range(heads[-1] + 1, i))]
        return broken[0] if broken else after[-1] if len(after) == 1 or not _subheading(texts[after[-1]]) else after[-2]
    return after[0] if after else plain[-1]


def _subheading(text: str) -> bool:
    return len(text.split()) <= 2


def _mark_teasers(texts: list[str], kinds: list[str], title: int) -> None:
    """Short lines that belong to a list of teasers become teasers."""
    n = len(texts)
    for i in range(n):
        if kinds[i] != "teaser head":
            continue
        j = i + 1
        run = []
        while j < n and j != title and kinds[j] in ("short", "numbered", "teaser"):
            run.append(j)
            j += 1
        # a short unmarked line just before prose may be a heading of the body
        if run and j < n and kinds[j] in ("prose", "item") and title < i and kinds[run[-1]] == "short" and len(run) > 1:
            run.pop()
        elif run and j < n and kinds[j] in ("prose", "item") and kinds[run[-1]] == "short" and len(texts[run[-1]].split()) <= 3:
            run.pop()
        for r in run:
            kinds[r] = "teaser"
    for i in range(n):  # teasers without a head: between or beside marked ones
        if kinds[i] in ("short", "numbered") and i != title:
            before = kinds[i - 1] if i else ""
            after = kinds[i + 1] if i + 1 < n else "frame"
            long_enough = len(texts[i].split()) >= 4
            if before in ("teaser", "teaser head") and after in FRAME and long_enough:
                kinds[i] = "teaser"
            elif after == "teaser" and before in FRAME and long_enough and title >= 0 and i > title:
                kinds[i] = "teaser"


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers, frames, out = [], [], [], []
        for k, text, often in zip(*(b.column(i).to_pylist() for i in range(3))):
            lines, frame = frame_of_page(text or "", _repeated(text or "", often))
            for number, line in lines:
                ids.append(k)
                numbers.append(number)
                frames.append(number in frame)
                out.append(line)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(frames, pa.bool_()), pa.array(out, pa.string())], names=["chunk_idx", "line_no", "is_frame", "line"])


_DIGITS = re.compile(r"[0-9]+")


@lru_cache(maxsize=200_000)
def _key(line: str) -> int:
    """A hash of a line, case, blanks and digits folded; 0 for a blank line."""
    words = _DIGITS.sub("0", line.lower()).split()
    return int.from_bytes(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if words else 0


def _repeated(text: str, often: list[int] | None) -> list[bool] | None:
    """Of each line whether its key is among those its site repeats."""
    if not often:
        return None
    keys = set(often)
    return [_key(line) in keys for line in text.split("\n")]


def _count_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, key, n): pages of a batch that hold a line."""
    for b in batches:
        counts: Counter[tuple[str, int]] = Counter()
        for site, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.update((site, key) for key in set(map(_key, (text or "").split("\n"))) if key)
        sites, keys = zip(*counts) if counts else ((), ())
        yield pa.record_batch([pa.array(sites, pa.string()), pa.array(keys, pa.int64()), pa.array(counts.values(), pa.int64())], names=["site", "key", "n"])


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(site, often): of each site the keys of the lines that belong to its frame."""
    known = pages.where("site is not null and site <> ''").select("site", "text")
    lines = known.mapInArrow(_count_step, "site string, key bigint, n bigint").groupBy("site", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES)
    sizes = known.groupBy("site").agg(F.count("*").alias("pages"))  # reads no text
    often = lines.join(sizes, "site").where(F.col("n") >= SITE_SHARE * F.col("pages"))
    return often.groupBy("site").agg(F.collect_list("key").alias("often"))  # at most lines of a page / SITE_SHARE a site


def _marked(df: DataFrame, id_col: str, text_col: str, site: Column | None) -> DataFrame:
    """(id, text, often): the pages, with the keys of the lines that their site repeats."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), (F.lit(None).cast("string") if site is None else site).alias("site")).where("id is not null")
    if site is None:
        return rows.select("id", "text", F.lit(None).cast("array<bigint>").alias("often"))
    often = cut(repeated_lines(rows))
    size = often.agg(F.coalesce(F.sum(F.size("often")), F.lit(0)).alias("n")).first().n
    return rows.join(F.broadcast(often) if size <= BROADCAST_KEYS else often, "site", "left").select("id", "text", "often")


def page_lines(df: DataFrame, id_col: str, text_col: str, site: Column | None = None) -> DataFrame:
    """(chunk_idx, line_no, is_frame, line) of every non-blank line; ``site`` names a page's site."""
    return _marked(df, id_col, text_col, site).mapInArrow(_step, RESULT)


def page_bodies(df: DataFrame, id_col: str, text_col: str, site: Column | None = None) -> DataFrame:
    """(chunk_idx, body) of every row: the body's lines, in order; null text gives ""."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, often in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines, frame = frame_of_page(text or "", _repeated(text or "", often))
                out.append("\n".join(line for no, line in lines if no not in frame))
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["chunk_idx", "body"])

    return _marked(df, id_col, text_col, site).mapInArrow(step, "chunk_idx bigint, body string")
