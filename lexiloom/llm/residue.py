"""Problem 9: template residue, filler, error pages and demands for scripts in place of content.

Documents are cut into paragraphs. Trusted labels are few: a document that is nothing but a stock notice (error page, stack
trace, demand for scripts), one that holds nothing but stock filler under its title, a paragraph of Latin filler, an unfilled
template field. Everything else is found by likeness: paragraphs get SimHash fingerprints of their five-word shingles, which
are partitioned by the shingles with the smallest hashes, at every size of the corpus by the same rule and so many that
every pair at the threshold shares a partition; starting from trusted paragraphs, those that share a partition and are
near by Hamming distance are candidates, the candidates of these too, and so on; the texts of all candidate pairs are
compared exactly, and labels spread through the connected components of the pairs that are similar. A document is residue if one of its
paragraphs is filler, or if all of them but a title are notices. So a notice under a title, or filler between good
paragraphs, counts only if the corpus shows the same wording as residue of its own.

Codes in notices differ from copy to copy: words with a digit, words alone in brackets and words after a cue ("ref", "url")
are alike. Navigation and copyright lines are no content. A paragraph that is quoted line by line is content, but never
residue. Unfilled fields stay with their document, since a copy with the fields filled in is a good text.

Defined results: null and empty texts are no residue. A paragraph of fewer than five words is one shingle, one without any
word is content that joins nothing. Equal documents get equal labels, but for trust. A component with several trusted labels
gets the one that most of its trusted paragraphs have, ties go to the first by name. Documents with a null id count as
evidence, but only ids come out. Extra columns are ignored, empty input gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels, words
from lexiloom.llm.bits import bit_map, map_size, marked
from lexiloom.operators.graph import components
from lexiloom.runtime import cut, spread

PRINT_BYTES = 64
_NAME = r"[A-Za-z][A-Za-z]*(?:[ _.\-][A-Za-z]+){0,4}"
# What placeholders in brackets of prose name.
_FILL = r"(?:your|insert|enter|recipient|customer|client|company|first ?name|last ?name|full ?name|name|date|amount|link|url|address|phone|email|title|subject|city|order(?: id| number)?|account|signature|votre|ihre?|su|nom|nombre|datum|fecha|betrag)"
_FIELD = re.compile(
    r"\{\{\s*[#/^]?" + _NAME + r"\s*\}\}"
    r"|\{%\s*[^%{}\n]+\s*%\}|<%=?\s*[^%<>\n]+\s*%>"
    r"|[#$]\{" + _NAME + r"\}"
    r"|(?<![\w{#$])\{(?:[A-Za-z][A-Za-z_.]+|\d{1,2})\}(?!\})"
    r"|\[\[\s*" + _NAME + r"\s*\]\]|<<\s*" + _NAME + r"\s*>>"
    r"|%%" + _NAME + r"%%|(?<![\w%])%[A-Za-z_]{3,}%(?![\w%])|@@[A-Za-z_]{2,}@@|\*\|[A-Za-z_:]{2,}\|\*"
    r"|(?<![\w_])__[A-Za-z]+(?:_[A-Za-z]+)*__(?![\w_])|(?<![\w$])\$[A-Za-z_]{3,}\$(?![\w$])"
    r"|\[(?i:" + _FILL + r")(?: [A-Za-z ]+)?\]"
    r"|<(?i:" + _FILL + r")(?: [A-Za-z ]+)?>"
)
_OPENS = r"\{[{%A-Za-z0-9]|<[%<A-Za-z]|\[[\[A-Za-z]|%[%A-Za-z_]|@@|\*\||__|\$[A-Za-z_{]"
#: Words right before or after a placeholder that is talked about instead of left unfilled.
_INTRODUCES = re.compile(r"(?i)(?:\b(?:explains? (?:that|how|why)|variables?|(?:the|a) (?:field|placeholder|tag|token|marker|string|syntax|pattern|expression)|such as|e\.g\.|of the form|called|named|is written as|replaces?)|[\"“„«'‘`])\s*$")
_REMARKS = re.compile(r"(?i)^(?:[\"”“»'’`]|\s*(?:style|placeholders?|variables?|tags?|markers?|syntax|points? to|stands? for|means|(?:is|are) (?:a |the )?(?:placeholders?|fields?|variables?)|fields? (?:is|are))\b)")

# Words of the usual Latin filler.
_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque".split()
# How stock filler begins.
_FILLER = r"(?i)^(?:(?:tbd|tba|todo|x{3,}|n/?a)\b|\.\.\.|to be (?:written|done|added|determined|announced|completed)|(?:your )?(?:text|content|copy|title|headline) (?:goes |comes )?here\b|your (?:text|content) will appear|(?:sub-?)?(?:head(?:line|ing)?|title|caption) here\b|placeholder\b|(?:sample|dummy|filler|example) (?:paragraph|text|copy|content)\b|(?:replace|insert|write) (?:this|your|two|a few)\b|blindtext\b|platzhalter|mustertext\b|hier (?:steht|kommt|folgt)\b|text folgt\b|(?:votre |faux )?texte (?:à venir|ici)\b|contenu à venir\b|titre ici\b|texto (?:de (?:relleno|ejemplo|muestra)|provisional)\b|(?:texto|título|contenido) (?:aquí|pendiente)|lorem ipsum\b|coming soon\b|under construction\b|(?:asdf|qwer(?:ty)?|jkl|foo|bar|baz|blah?)\b)"
# How stock notices begin, in English, German, French and Spanish; reason phrases as in the HTTP standard.
_REASON = r"(?:not found|forbidden|unauthorized|bad (?:gateway|request)|internal server error|(?:service )?(?:temporarily )?unavailable|gateway timeout|too many requests|gone)"
_ERROR = (
    r"(?i)^(?:(?:oops|sorry|we(?:'|’| a)re sorry|error|erreur|fehler|lo sentimos|désolée?)[,.!:]* )?(?:"
    r"(?:error|http(?:/[\d.]+)?|erreur|fehler)[ :]*[45]\d\d\b|[45]\d\d[ :\-–]+" + _REASON + r"|" + _REASON + r"(?:\W|$)"
    r"|access (?:is )?denied(?:[.:!\n]|$)|accès (?:refusé|interdit)|zugriff verweigert|acceso denegado|permission denied"
    r"|(?:fatal error|uncaught exception|traceback \(most recent|stack trace|[\w.$]+(?:exception|error)(?::|\n|$))"
    r"|(?:(?:the|this|your|that|die|das|diese|la|le|cette|ce|el|esta|este) )?(?:requested |angeforderte )?(?:page|file|document|resource|message|url|seite|datei|adresse|ressource|nachricht|fichier|página|archivo|recurso|mensaje)\b(?:[^.\n]* )?(?:not found|could not be \w+|cannot be \w+|was not found|no longer exists|introuvable|(?:wurde |konnte )?nicht gefunden|existiert nicht|no (?:se )?(?:ha (?:sido )?)?encontrad[ao]|no existe)"
    r"|(?:your|ihre|die|votre|la|su) (?:session|sitzung|sesión)\b[^.\n]*(?:timed out|expired|abgelaufen|expiré|caducado|expirado)"
    r"|erreur (?:interne|du serveur)|serverfehler|error (?:interno|de conexión|del servidor)|(?:error|fehler) (?:establishing|bei der) "
    r"|(?:an (?:unexpected |internal )?error (?:has )?occurred|something went wrong|you have been rate limited|you do not have permission))"
)
_SCRIPT = (
    r"(?i)^(?:please|you (?:need|must|have) to|to (?:view|use|continue|read)|th(?:is|e) (?:site|page|app\w*|website)|your browser|we(?:'|’| ha)ve (?:detected|noticed)|java ?script|scripts?\b|cookies|enable|activ\w+|turn on|allow|bitte|um|aktivieren|ihr browser|veuillez|pour|votre navigateur|por favor|para|su navegador|habilit\w+)\b[^.\n]*"
)
_DEMAND = re.compile(
    r"(?i)(?:(?:enabl\w*|activ\w*|allow\w*|requir\w*|need\w*|turn\w* (?:it )?o[nf]f?|switched off|disabled|deaktiviert|aktivier\w*|habilit\w*|désactivé\w*|does not support|unterstützt|blocked)[^.\n]*\b(?:java ?script|scripts?|cookies)\b|\b(?:java ?script|scripts?|cookies)\b[^.\n]*(?:enabl\w*|activ\w*|allow\w*|requir\w*|need\w*|turned off|turn\w* (?:it )?on|switched off|disabled|deaktiviert|aktivier\w*|habilit\w*|désactivé\w*|blocked|must be))"
)
#: Lines of a stack trace, and what wordy notices advise; they count in a block that begins as a notice.
_TRACE = re.compile(r"(?i)^\s*(?:at \S+ ?\([^()\n]*\)|File \"[^\"\n]+\", line \d+|caused by:|\.\.\. \d+ (?:more|common)|#\d+ )")
_ADVICE = re.compile(r"(?i)\b(?:(?:your|the|this) browser|reload|refresh|browser'?s? settings|contact (?:us|support|the \w+|your \w+)|administrator|webmaster|go back|return to|try again|retry|before you continue|wait a moment|inténtelo|versuchen sie es|réessayez|check the (?:address|url|link)|(?:we are|we're) sorry|apologi[sz]e|(?:trace|incident|request|reference|error) (?:id|number|code)?)\b")
_NAV = r"(?im)^[ \t]*(?:(?:©|\(c\)|copyright)[^\n]*|all rights reserved[^\n]*|skip to content|back to (?:list|top|home)[^\n]*|[\pL\pN\-]+(?: [\pL\pN\-]+){0,2}(?: ?[|·»] ?[\pL\pN\-]+(?: [\pL\pN\-]+){0,2})+|(?:(?:home|menu|search|sign in|log in|login|archive|help|imprint|terms|contact|about|privacy|next|previous) ?)+)[ \t]*$"
_STARTS_ERROR, _STARTS_SCRIPT, _STARTS_FILLER = (re.compile(p) for p in (_ERROR, _SCRIPT, _FILLER))
_WORD = re.compile(r"[^\W\d_]{2,}")
# Words that a code follows.
_CUES = "code ref reference trace ray id incident url address adresse page loading session token request".split()


def _latin_share(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of Latin filler in the words of each block; 0 for fewer than four words."""
    own = np.isin(h, words.hashed_words(pa.array([" ".join(_LATIN)]))[0])
    upto = np.concatenate([[0], np.cumsum(own)])
    ends = np.cumsum(counts)
    return np.where(counts >= 4, (upto[ends] - upto[ends - counts]) / np.maximum(1, counts), 0.0)


def _latin(said: str) -> bool:
    return bool(_latin_share(*words.hashed_words(pa.array([said.lower()])))[0] >= 0.9)


def _kind(block: str) -> str | None:
    """What a block is that begins as stock residue: half of its sentences or clauses must be of that kind."""
    if _STARTS_FILLER.match(block):
        said = [s.strip() for s in re.split(r"(?<=[.!?,])\s+|\n", block) if s.strip()]
        if sum(bool(_STARTS_FILLER.match(s)) or _latin(s) for s in said) * 2 >= len(said):
            return "filler"
    script = lambda s: bool(_STARTS_SCRIPT.match(s) and _DEMAND.search(s))
    said = [s for s in re.split(r"(?<=[.!?])\s+|\n", block) if s.strip()]
    said = said[:1] + [s for s in said[1:] if len(_WORD.findall(s)) > 1]  # codes and the like count neither way
    if not said or not (_STARTS_ERROR.match(block) or script(said[0])):
        return None
    kinds = ["script" if script(s) else "error" if _STARTS_ERROR.match(s) or _TRACE.match(s) or _ADVICE.search(s) else "" for s in said]
    return None if sum(map(bool, kinds)) * 2 < len(said) else "script" if "script" in kinds else "error"


def has_open_field(text: str) -> bool:
    """Whether a template field stands unfilled in the text and is not quoted or talked about."""
    return any(not (_INTRODUCES.search(text[max(0, m.start() - 40) : m.start()]) or _REMARKS.search(text[m.end() : m.end() + 30])) for m in _FIELD.finditer(text))


def blocks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Paragraphs of all texts without navigation lines, and the number of the text that each belongs to."""
    lists = pc.split_pattern_regex(pc.replace_substring(pc.fill_null(column, ""), "\r\n", "\n"), r"\n\s*\n")
    flat = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.list_flatten(lists), _NAV, ""))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), pc.list_parent_indices(lists).filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def _forms(made: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words.hashed_words(pc.utf8_lower(made), alike_numbers=True, cues=_CUES)


def _sets(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingles of each block; a block of one to four words has one, all its words."""
    s, _, per = words.shingles(h, counts)
    few = np.flatnonzero((counts > 0) & (per == 0))
    if len(few):
        ends = np.cumsum(counts)
        extra = np.array([np.bitwise_xor.reduce(h[ends[i] - counts[i] : ends[i]] * np.arange(1, 2 * counts[i], 2, dtype=np.uint64)) for i in few], np.uint64)
        at = (np.cumsum(per) - per)[few]
        s, per = np.insert(s, at, extra), per.copy()
        per[few] = 1
    return s, per


UNIT = "id long, block int, n int, label string, k1 long, k2 long, size int, parts array<int>, p array<long>"


def _judged(seed: int, least: float):
    """Rows of UNIT: one for each content block that can be residue, and one of block -1 for a text with an unfilled field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole)):
            made, own = blocks(batch.column("text"))
            n = batch.num_rows
            first = np.diff(own, prepend=-1) > 0
            start = np.searchsorted(own, np.arange(n))
            number = np.arange(len(own)) - start[own]
            several = np.bincount(own, minlength=n)[own] > 1
            as_mask = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
            kinds = np.full(len(own), None, object)
            holds = lambda pattern: as_mask(pc.match_substring_regex(made, pattern))
            likely = np.flatnonzero(holds(_ERROR) | holds(_FILLER) | holds(_SCRIPT) & holds(r"(?i)script|cookies"))  # what passes is judged sentence by sentence
            for i, block in zip(likely, made.take(pa.array(likely)).to_pylist()):
                kinds[i] = _kind(block)
            h, counts = _forms(made)
            latin = _latin_share(h, counts) >= 0.9
            kinds[latin] = "filler"
            known = kinds != None  # noqa: E711
            title = first & several & ~known & ~holds(r"\n|[.!?…:;,]$")
            content = np.bincount(own[~title], minlength=n)
            of = lambda mask: np.bincount(own[mask], minlength=n)
            filler, notice = kinds == "filler", (kinds == "error") | (kinds == "script")
            only_filler, only_notice = of(filler) == content, (of(notice) == content) & (of(title) == 0)
            trusted = latin | filler & only_filler[own] | notice & only_notice[own]
            s, per = _sets(h, counts)
            codes, size = kernels.distinct(s >> np.uint64(32), per)
            kept = np.flatnonzero(~title & (per > 0) & ~holds(r"^(?:>[^\n]*(?:\n|$))+$"))
            prints = kernels.simhash(codes, size, PRINT_BYTES * 8, seed)[kept]
            digest = kernels.digests(h.view(np.uint8), np.concatenate([[0], np.cumsum(counts * 8)]))[kept]
            label = [x if t else None for x, t in zip(kinds[kept], trusted[kept])]
            lists = pa.ListArray.from_arrays(np.arange(0, prints.size // 8 + 1, PRINT_BYTES // 8, dtype=np.int32), prints.view(np.int64).ravel())
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(own[kept])), pa.array(number[kept].astype(np.int32)), pa.array(content[own[kept]].astype(np.int32)), pa.array(label, pa.string()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(size[kept].astype(np.int32)), _prefixes(codes, size, per, kept, least), lists], UNIT_NAMES
            )
            opens = np.flatnonzero(as_mask(pc.match_substring_regex(batch.column("text"), _OPENS)))
            fields = [i for i, t in zip(opens, batch.column("text").take(pa.array(opens)).to_pylist()) if has_open_field(t)]
            if fields:
                none = lambda kind: pa.nulls(len(fields), kind)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(fields)), pa.array([-1] * len(fields), pa.int32()), none(pa.int32()), pa.array(["field"] * len(fields)), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int32())), none(pa.list_(pa.int64()))], UNIT_NAMES)

    return run


UNIT_NAMES = ["id", "block", "n", "label", "k1", "k2", "size", "parts", "p"]


def _prefixes(codes: np.ndarray, size: np.ndarray, per: np.ndarray, kept: np.ndarray, least: float) -> pa.ListArray:
    """The smallest codes of each kept set, so many that two sets at `least` share one: all but `least` of a set, and one.

    Codes stand for shingles of more bits in the same order; `per` is the number of shingles, at least that of codes.
    """
    most = np.minimum(size, per - np.ceil(per * least - 1e-9).astype(np.int64) + 1)[kept]
    starts, ends = (np.cumsum(size) - size)[kept], np.cumsum(most)
    at = np.arange(most.sum()) + np.repeat(starts - ends + most, most)
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(codes[at].view(np.int32)))


def _posted(keep: np.ndarray | None = None):
    """(part, k1, k2, size, p): the smallest shingles of each class, or those only that the map `keep` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").flatten().to_numpy().astype(np.int64)
            row = pc.list_parent_indices(batch.column("parts")).to_numpy()
            hit = np.arange(len(parts)) if keep is None else np.flatnonzero(marked(keep, parts))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(parts[hit]), *(batch.column(c).take(at) for c in ("k1", "k2", "size", "p"))], ["part", "k1", "k2", "size", "p"])

    return run


POSTED = "part long, k1 long, k2 long, size int, p array<long>"


def _wanted_forms(wanted: np.ndarray):
    """(id, block, form): all content blocks of the documents whose id the map `wanted` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.take(pa.array(np.flatnonzero(marked(wanted, batch.column("id").to_numpy()))))
            for own in kernels.slices(part):
                made, text = blocks(own.column("text"))
                number = np.arange(len(text)) - np.searchsorted(text, np.arange(own.num_rows))[text]
                yield pa.RecordBatch.from_arrays([own.column("id").take(pa.array(text)), pa.array(number.astype(np.int32)), made], ["id", "block", "form"])

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole, "fa", 1 << 20)):
            sides = []
            for c in ("fa", "fb"):
                s, per = _sets(*_forms(batch.column(c)))
                sides.append((s, np.concatenate([[0], np.cumsum(per)])))
            (a, ao), (b, bo) = sides
            kept = []
            for i in range(batch.num_rows):
                x, y = np.unique(a[ao[i] : ao[i + 1]]), np.unique(b[bo[i] : bo[i + 1]])
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and shared >= least * (len(x) + len(y) - shared):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int32()))

    return run


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, radius: int = 138, seed: int = 17) -> DataFrame:
    """(id, label, trusted) of every document to exclude; label is field, filler, error or script, trusted whether its own rules say so.

    radius: bits in which the 512-bit fingerprints of candidates may differ; pairs at 0.8 differ in 77 with a standard
    deviation of 8, pairs of blocks with fewer than ten shingles in up to 98.
    """
    folded = words.folded(F.col(text_col))
    rows = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), folded.alias("text")))
    units = cut(rows.mapInArrow(_judged(seed, least), UNIT), "units")
    worded = units.where("block >= 0")
    # one class for all paragraphs with the same words; any fingerprint of a class is its fingerprint
    classes = worded.groupBy("k1", "k2").agg(F.first("size").alias("size"), F.first("parts").alias("parts"), F.first("p").alias("p"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "block"))).alias("at"), F.max(F.col("label").isNotNull()).alias("trusted"))
    classes = cut(classes, "classes")
    found = cut(classes.where("trusted").select("k1", "k2", "size", "parts", "p"), "reached")
    frontier, near = found, None
    apart = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(PRINT_BYTES // 8)), F.lit(0))
    while frontier is not None:
        posted = cut(frontier.mapInArrow(_posted(), POSTED), "posted")
        keep = bit_map(posted, "part", map_size(posted.count()))
        other = classes.mapInArrow(_posted(keep), POSTED).select("part", F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("size").alias("other"), F.col("p").alias("q"))
        as_long = (F.col("size") >= F.col("other") * (least - 1e-9)) & (F.col("other") >= F.col("size") * (least - 1e-9))
        met = posted.join(other, "part").where(((F.col("k1") != F.col("l1")) | (F.col("k2") != F.col("l2"))) & as_long & (apart <= radius))
        met = cut(met.select("k1", "k2", "l1", "l2").distinct(), "met")
        near = met if near is None else near.unionByName(met)
        new = met.select(F.col("l1").alias("k1"), F.col("l2").alias("k2")).distinct().join(found, ["k1", "k2"], "left_anti")
        new = cut(new.join(classes.select("k1", "k2", "size", "parts", "p"), ["k1", "k2"]), "reached")
        frontier = new if new.limit(1).count() else None
        found = found.unionByName(new)
    place = lambda x, k, m: classes.select(F.col("k1").alias(k), F.col("k2").alias(m), F.concat_ws(":", "k1", "k2").alias(x), F.col("at").alias(f"at_{x}"))
    pairs = near.join(place("a", "k1", "k2"), ["k1", "k2"]).join(place("b", "l1", "l2"), ["l1", "l2"]).where("at_a is not null and at_b is not null")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("at_a")).otherwise(F.col("at_b")).alias("at_a"), F.when(F.col("a") < F.col("b"), F.col("at_b")).otherwise(F.col("at_a")).alias("at_b")).distinct(), "pairs")
    places = pairs.select("at_a.id").unionByName(pairs.select("at_b.id"))
    forms = cut(rows.where("id is not null").mapInArrow(_wanted_forms(bit_map(places, "id", map_size(2 * pairs.count()))), "id long, block int, form string"), "forms")
    form = lambda x: forms.select(F.struct("id", "block").alias(f"at_{x}"), F.col("form").alias(f"f{x}"))
    full = pairs.join(form("a"), "at_a").join(form("b"), "at_b")
    edges = cut(full.mapInArrow(_alike(least), "a string, b string").distinct(), "edges")
    # the label of a component, and of a trusted class without neighbours, for all their paragraphs
    linked = components(edges, "a", "b")
    told = worded.where("label is not null").groupBy("k1", "k2", "label").agg(F.count("*").alias("votes")).withColumn("node", F.concat_ws(":", "k1", "k2"))
    told = told.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component"), "label").agg(F.sum("votes").alias("votes"))
    told = told.groupBy("component").agg(F.max_by("label", F.struct("votes", F.concat(F.lit(""), F.translate("label", "efs", "zyx")))).alias("said"))
    named = found.select(F.concat_ws(":", "k1", "k2").alias("node"), "k1", "k2").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(told, "component").select("k1", "k2", "said")
    judged = worded.join(named, ["k1", "k2"]).groupBy("id").agg(
        F.max("n").alias("n"), F.count_if(F.col("said") == "filler").alias("filler"), F.count_if(F.col("said") != "filler").alias("notices"), F.max(F.col("said") == "script").alias("script"), F.max(F.col("label").isNotNull()).alias("trusted")
    )
    judged = judged.where("filler > 0 or notices = n").select("id", F.when(F.col("filler") > 0, "filler").when(F.col("script"), "script").otherwise("error").alias("label"), "trusted")
    open_ = units.where("block = -1").select("id", "label", F.lit(True).alias("trusted"))
    both = judged.unionByName(open_).where("id is not null").groupBy("id")
    return both.agg(F.coalesce(F.min(F.when(F.col("label") != "field", F.col("label"))), F.lit("field")).alias("label"), F.max("trusted").alias("trusted"))
