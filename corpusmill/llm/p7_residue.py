"""Problem 7: template residue, filler, error pages and script notices in place of content.

Method: every document gives detector hits (unfilled placeholders, filler, error messages, notices that
scripts are needed) and, if it says little, a response key: the digest of its body with numbers and rare
words, such as names, masked. Keys are counted by host: how often a response was served, by how many
hosts, and under how many different address slugs and titles. A document is residue if its evidence adds
up to ENOUGH: a detector's hit is enough alone; a word that such notices have, a slug or title none of
whose terms stand in the body, a response served again and again, one that several hosts serve, and one
that its host serves under different slugs or titles are worth one each. Sentences that explain such
things are no hits, nor is a single line at the foot of an article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.rarity import Rarity, word_rarity
from corpusmill.llm.screen import Detector, Screen
from corpusmill.llm.words import fold, words
from corpusmill.plans.layout import materialise, table

# Names of fields that templates fill in; needed where the brackets alone are common.
FIELDS = (
    r"(?:your |first |last |full |user |customer |order |company |product |site |page |post |event |insert )?"
    r"(?:name|title|author|company|price|date|city|venue|product|link|amount|summary|headline|number|email|address|phone|"
    r"url|text|topic|category|location|country|street|subject|keyword|brand|time|year|month|day|username|user|customer|"
    r"order|description|logo|image|here)"
)
NAMED = r"[ ]*" + FIELDS + r"(?:[._ ]?" + FIELDS + r")?[ ]*"
PLACEHOLDER = Detector(
    r"\{\{[{%#]?\s*[a-z_][\w .|'-]{0,40}\s*[}%]?\}\}|\$\{\s*[a-z_][\w .]{0,40}\}|<%=?\s*[\w .@]{1,40}%>|\[\[\s*[a-z_][\w .]{0,40}\]\]"
    r"|\[(?:insert|your) [\w .'-]{1,40}\]|\((?:insert|your) [\w .'-]{1,40} here\)|\*\|[\w .:]{1,40}\|\*|@@[\w .]{1,40}@@|<<[a-z_][\w .]{0,40}>>|%%[\w .]{1,40}%%"
    r"|__[a-z][a-z .]{1,30}(?:_[a-z]+)?__|(?<![\w%])%[a-z][a-z_ .]{2,30}%(?!\w)"
    rf"|\{{{NAMED}\}}|\[{NAMED}\]|<{NAMED}>|#{NAMED}#|«{NAMED}»",
)
FILLER = Detector(
    r"lorem ipsum dolor|ipsum dolor sit|\bdolor sit amet|\bblah blah blah|\btext text text|\basdf\b.*\b(?:asdf|jkl)|\bxxxx+ xxxx"
    r"|your (?:text|content|title|headline) (?:goes )?here|(?:text|headline|content|title|caption|copy|image) goes here"
    r"|placeholder text|sample (?:text|paragraph|content)|dummy text|click to edit|type something|insert (?:copy|text) ?(?:here)?$"
    r"|^insert copy|^(?:tbd|tba)\b[.:]?|^todo\b\s*:|add a short description|replace (?:this )?(?:before|with your)|edit this text"
    r"|write your (?:text|content) here|coming soon\W*$|under construction\W*$|untitled document"
)
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum".split()
)
ERROR = Detector(
    r"^\W*(?:http |error |erreur |fehler |errore |erro )?[45]\d\d\b\W*(?:-|:|\||error|bad|forbidden|not|gone|internal|service|gateway|unauth\w*|request|too|the page)"
    r"|^\W*(?:http )?error \d{3}\b|\b(?:500|internal) (?:internal )?server error|internal server error|bad gateway|gateway time-?out"
    r"|service (?:temporarily )?unavailable|^\W*access denied|(?:page|file|document|site) (?:you were looking for|you requested|requested|not found|cannot be found)"
    r"|page (?:could )?not (?:be )?found|could not be found\b.*|this (?:site|page) can'?t be reached|took too long to respond"
    r"|error establishing a database|fatal error:|warning: undefined|call to undefined|traceback \(most recent|stack trace"
    r"|(?:java|javax|org|com)\.[\w.]+(?:exception|error)\b|nullpointerexception|undefined (?:variable|index|function)"
    r"|down for (?:scheduled )?maintenance|captcha check|prove that you are not a robot|are not a robot|verify (?:that )?you are (?:a )?human"
    r"|session (?:has )?expired|log ?in again|invalid or expired|too many requests|slow down and retry|no results found for"
    r"|not available in your (?:region|country)|blocked by the security|have permission to (?:access|view)|something went wrong"
    r"|engineers have been notified|nothing at this address|no longer available|removed permanently|server met an unexpected"
    r"|dns failure|check the spelling or|request a new link|\"error\": ?\"|\"status\": ?[45]?\d+, ?\"error|contact the administrator"
    r"|page non trouvee|n'existe plus sur ce serveur|erreur interne|acces refuse|reessayez plus tard|seite (?:wurde )?nicht gefunden"
    r"|zugriff verweigert|sitzung .{0,12}ist abgelaufen|angeforderte (?:adresse|seite)|existiert nicht mehr|interner serverfehler"
    r"|error interno|fallo interno|pagina no encontrada|acceso denegado|intentelo mas tarde|pagina non trovata|accesso negato"
    r"|errore interno|pagina nao encontrada|acesso negado|erro interno|sessao expirada|sesion ha (?:expirado|caducado)"
    r"|页面不存在|错误代码|服务器错误|访问被拒绝|找不到(?:该)?页面|无法访问"
)
SCRIPT = Detector(
    r"\b(?:enable|activate|turn on|switch on|allow|requires?|needs?|without|no) (?:\w+ ){0,2}(?:javascript|java script|js|scripts?|scripting)\b"
    r"|\b(?:javascript|js|scripts?|scripting) (?:and cookies )?(?:is|are|must be|needs to be|has to be|should be) (?:\w+ )?(?:disabled|off|blocked|enabled|turned|required|switched|needed)"
    r"|turn (?:on|it on)? ?(?:javascript|js)|<noscript>|^noscript|browser does not support|check(?:ing)? your browser|has no js support"
    r"|client-side scripting|scripts are blocked|(?:active|activer|activez|aktivieren sie|activar|habilite|attiva\w*|ative) javascript"
    r"|javascript (?:desactive|deshabilitado|deaktiviert|disattivato|desativado)|启用 ?javascript|需要 ?javascript|turn them on and reload"
    r"|\b(?:until|unless) (?:they|it|scripts?|javascript) (?:is|are) (?:allowed|enabled|permitted|switched on|turned on)"
)
#: Sentences about such things, not such things.
EXPLAINS = re.compile(
    r"\b(?:in a template|markers?|such as|the words?|the phrase|the term|swapped|replaced by|expands|generic type|the set|print\(|"
    r"format strings?|status codes?|tells the|once|used to|should still|said|says|wrote|explain\w*|means|meant|stands for|called|known as|"
    r"(?:article|lecture|chapter) (?:on|about)|how to|for example|history of|designers?|depends? on)\b|print\("
)
WEAK = re.compile(
    r"\b(?:error|unavailable|forbidden|not found|denied|expired|blocked|disabled|robot|retry|reload|redirect\w*|unsupported|"
    r"maintenance|offline|loading|please wait|permission|timeout|timed out|invalid|failed|cookies|javascript|js|scripts?|scripting|"
    r"browser|navigateur|navegador|https?|html|server|serveur|servidor|erreur|errore|erro|fehler)\b"
)
NEUTRAL = re.compile(
    r"^\W*(?:menu|search|login|log in|sign in|register|home|about|contact|home \| about \| contact|.?\W*all rights reserved|"
    r"share this page|back to top|skip to content|subscribe|print|next|previous|\d+|ref(?:erence)?\W[\d -]+|id \d+|ray \d+|ticket \d+)\W*$"
)
UNIT = re.compile(r"\n+|(?<=[.!?。])\s+")


DETECTORS = [("placeholder", PLACEHOLDER), ("filler", FILLER), ("script", SCRIPT), ("error", ERROR)]
#: The literals of each detector, and words of filler Latin, in the order of their bits.
SCREEN = Screen([*(d.literals for _, d in DETECTORS), {w for w in LATIN if len(w) > 3}])


def kind_of(unit: str, bits: int) -> str | None:
    """The detector that a line or sentence, folded, sets off; bits tell whose literals it has.

    Filler Latin has six words or more, four fifths of them of the known ones, one of these longer than
    three letters.
    """
    kind = next((kind for k, (kind, detect) in enumerate(DETECTORS) if detect(unit, bool(bits >> k & 1))), None)
    if kind is None and bits >> len(DETECTORS):
        w = words(unit)
        if len(w) >= 6 and sum(x in LATIN for x in w) >= 0.8 * len(w):
            kind = "filler"
    return kind if kind and not EXPLAINS.search(unit) else None


#: Articles have at least so many words before a line at their foot.
ARTICLE_WORDS = 15
#: A low-information body has at most so many different words, whatever its length.
LOW_WORDS = 60
#: Nats of rarity, among bodies that say little, from which a word is masked, and words that a body must have
#: besides to be a response.
MASKED, PLAIN_WORDS = 6.2, 3
#: Evidence from which a document is residue, and times that a response must be served, hosts that must
#: serve it, and slugs or titles under which its host must serve it, for each to count.
ENOUGH, SERVED = 3, 3
#: The documents of one body are spread over so many parts when evidence is joined.
SALTS = 16


def terms(text: str) -> set[str]:
    """Words that say what a page is about: letters only, four or more of them (two in CJK don't occur: one each)."""
    return {x for x in words(text) if x.isalpha() and (len(x) > 3 or not x.isascii())}


def inspect(text: str | None, url: str | None) -> tuple[str | None, int, str | None, bytes | None]:
    """(kind of a detector's hit, weak and mismatch evidence, body, digest of slug and title).

    The body has numbers, and words of the slug and title, masked; it is None for texts with a hit, with
    fewer than PLAIN_WORDS other words, or with more than LOW_WORDS different words.
    """
    if not text or len(text) < 3 or text.isspace():
        return None, 0, None, None
    folded = fold(text)
    hits: list[tuple[int, int, str]] = []  # line, unit in line, kind
    content = 0
    in_code = False
    units_after_hit = 0
    lines = [x for x in folded.split("\n") if x.strip()]
    screened = SCREEN.bits(folded)  # most texts have no literal at all
    for n, line in enumerate(lines):
        if "```" in line:
            in_code = not in_code
            continue
        if in_code:
            continue
        if NEUTRAL.match(line):
            continue
        units = UNIT.split(line)
        may = SCREEN.bits(line) if screened else 0
        for m, unit in enumerate(units):
            unit = unit.strip()
            kind = kind_of(unit, SCREEN.bits(unit) if may and len(units) > 1 else may)
            if kind:
                hits.append((n, m, kind))
                units_after_hit = 0
            else:
                content += unit.count(" ") + 1
                units_after_hit += 1
    if hits:
        (n, m, kind), own = hits[-1], lines[hits[-1][0]]
        only_foot = (
            len(hits) == 1
            and m == 0
            and len(UNIT.split(own.strip())) == 1
            and units_after_hit == 0
            and content >= ARTICLE_WORDS
            and n > 0
        )
        return (None if only_foot else hits[0][2]), 0, None, None
    titled = len(lines) > 1 and lines[0].count(" ") < 10
    rest = "\n".join(lines[1:]) if titled else folded
    cut = rest.find(" ", 900)
    if cut > 0 and len(set(words(rest[:cut]))) > LOW_WORDS:
        return None, 0, None, None  # its beginning has too many already
    body = words(rest)
    if len(body) < 2 or len(different := set(body)) > LOW_WORDS:
        return None, 0, None, None
    title = terms(lines[0]) if titled else set()
    slug = terms(fold((url or "").partition("://")[2].partition("/")[2]))
    own = title | slug  # what the address or title says is masked where the body repeats it
    masked = ["#" if any(c.isdigit() for c in x) else "@" if x in own else x for x in body]
    if sum(x not in "#@" for x in masked) < PLAIN_WORDS:
        return None, 0, None, None
    weak = bool(WEAK.search(folded)) and not EXPLAINS.search(folded)
    apart = any(len(x) >= 2 and not x & different for x in (slug, title))
    named = xxhash.xxh3_128_digest(" ".join(sorted(slug)) + "|" + " ".join(sorted(title))) if own else None
    return None, weak + apart, " ".join(masked), named


def response_key(body: str, rarity: Rarity) -> bytes | None:
    """128 bits of a body with its rare words masked, too; None if fewer than PLAIN_WORDS are left."""
    masked = ["@" if x not in "#@" and rarity.of(x) >= MASKED else x for x in body.split(" ")]
    return xxhash.xxh3_128_digest(" ".join(masked)) if sum(x not in "#@" for x in masked) >= PLAIN_WORDS else None


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """(key, kind): documents whose content, or a part of it, is residue.

    kind is placeholder, filler, error, script, or evidence: ENOUGH of what the responses of all hosts, the
    address and the title tell. Null, empty, blank and very short texts are no case; a null url only takes
    away the slug and the host's evidence. Repeated rows give repeated results; other columns are not read;
    an empty table gives an empty one. Texts are read whole; what they give is written to the shared folder.
    Responses are counted by host and 128-bit key, combined before the shuffle; counts go back to the
    documents in SALTS parts, so a body that is a third of all pages is no single task.
    """

    @F.pandas_udf("struct<kind: string, points: int, body: string, named: binary>")
    def detect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, urls in batches:
            found = [inspect(t, u) for t, u in zip(texts.tolist(), urls.tolist())]
            yield pd.DataFrame(found, columns=["kind", "points", "body", "named"]).astype({"points": "int32"})

    host = F.nullif(F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z]+://([^/?#]+)", 1)), F.lit(""))
    seen = documents.select(F.col(key).alias("__key"), host.alias("host"), detect(F.col(text), F.col(url)).alias("d"))
    seen = seen.where("d.kind is not null or d.body is not null").select("__key", "host", "d.*")
    seen = materialise(seen, "residue")
    rarity = word_rarity(seen.where("body is not null").select(F.col("body").alias("text")))
    known = seen.sparkSession.sparkContext.broadcast(rarity)  # 2^22 bytes

    @F.pandas_udf("binary")
    def respond(bodies: pd.Series) -> pd.Series:
        return pd.Series([response_key(b, known.value) for b in bodies])

    bodies = seen.where("body is not null").select("__key", "host", "points", "named", respond("body").alias("response"))
    bodies = materialise(bodies.where("response is not null"), "responses")
    hit = seen.where("kind is not null").select("__key", "kind")
    # only documents with a point of their own can reach ENOUGH
    asked = bodies.where("points > 0").withColumn("salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    served = bodies.groupBy("response", "host", "named").agg(F.count(F.lit(1)).alias("n"))
    served = served.groupBy("response", "host").agg(F.sum("n").alias("n"), F.count("named").alias("names"))
    overall = served.groupBy("response").agg(F.sum("n").alias("n"), F.count("host").alias("hosts")).where(F.col("n") >= SERVED)
    by_host = served.where(F.col("host").isNotNull() & (F.col("names") >= SERVED)).select("response", "host", F.lit(1).alias("several"))
    points = F.col("points") + 1 + (F.col("hosts") >= SERVED).cast("int") + F.coalesce("several", F.lit(0))
    judged = (
        asked.join(overall.withColumn("salt", salts), ["response", "salt"])
        .join(by_host.withColumn("salt", salts), ["response", "host", "salt"], "left")
        .where(points >= ENOUGH)
        .select("__key", F.lit("evidence").alias("kind"))
    )
    return hit.unionByName(judged).withColumnRenamed("__key", key)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold residue instead of content."""
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue, by id and source."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", "source").join(find_residue(documents).select("doc_id"), "doc_id", "left_anti")


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found by kind: what the detectors find, and what only the hosts' evidence does."""
    return find_residue(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))
