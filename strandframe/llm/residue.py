"""Template residue, filler, error pages and scripts-required notices in place of real content.

Each text is taken apart into messages (sentences and lines). Placeholders, numbers, addresses, dates and codes are masked, so
that the copies of a message that differ in these become equal, and messages are hashed and grouped across documents and
sources. Only what recurs widely is classified, by phrase and placeholder rules, once for each form. Other short messages that
recur are the board's furniture (navigation, greetings); all else is the document's content. A document is residue if it has a
residue message and hardly any content. Filler generators never give the same sentence twice, so their words are grouped
instead: a word is filler if it stands in the standard texts or keeps company with them nearly everywhere in the corpus, and
messages made of such words have one masked form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.session import Shelf

# ------------------------------------------------------------------ masks

# The marks that masked parts leave; the section sign doesn't occur in a mask otherwise.
HOLE, ADDRESS, QUOTED, FILLER = "§p", "§a", "§q", "§f"

# Words in the names of the fields that templates fill in.
_FIELD = r"(?:name|first|last|full|user|username|author|site|board|company|body|text|title|subject|summary|description|content|question|answer|post|message|comment|vote|votes|count|date|time|email|address|link|url|tag|tags|number|id|city|product|topic)"
_FIELDS = rf"{_FIELD}(?:[_. ]{{1,3}}{_FIELD}){{0,3}}"
PLACEHOLDERS = (
    r"(?=[{<$#\[@_%(x])(?:\{\{[^{}\n]{0,60}\}\}|\{\d{1,2}\}|<%=?[^%\n]{0,60}%>|[$#]\{[^{}\n]{0,60}\}|\[\[[^\[\]\n]{0,60}\]\]|@@[^@\n]{1,60}@@|__[a-z][a-z_. ]{0,60}?__|%[a-z][a-z_.]{1,60}%"
    rf"|\[(?:insert|your|add|enter|einfügen|insérer|insertar)\b[^\[\]\n]{{0,60}}\]|\[{_FIELDS}\](?!\()|<{_FIELDS}>|\((?:add|insert|enter) [a-z ]{{2,40}}\)|\bx{{4,}}\b)"
)
#: In this order, over the lower-case texts that hold one of the given letters. What is quoted or code isn't the document's own message.
MASKS = (
    (("`", "~~~", "<"), r"(?s)(?=[`~<])(?:```.*?(?:```|\z)|~~~.*?(?:~~~|\z)|<(pre|code|blockquote)\b.*?(?:</\1>|\z))", f"\n{QUOTED}\n"),
    ((">", "&gt;", "    ", "\t"), r"(?m)^(?:[ \t]*+(?:>|&gt;)| {4}|\t).*$", f"\n{QUOTED}\n"),
    (("`",), r"`[^`\n]*\s[^`\n]*\s[^`\n]*`", f" {QUOTED} "),
    (("{", "<", "[", "@@", "__", "%", "(", "xxxx"), PLACEHOLDERS, f" {HOLE} "),
    (("<",), r"</?[a-z][a-z0-9]*\b[^<>\n]*>", "\n"),
    (("/", "www."), r"(?=[hw/])(?:https?://\S+|www\.\S+|(?:/[\w.-]++){2,})", f" {ADDRESS} "),
    (("@",), r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]+", f" {ADDRESS} "),
    # numbers, dates, times and codes
    ((), r"[a-f]*+\d[0-9a-f]*+(?:[-/.:,t]\d+)*+", "0"),
    (("  ", "\t", "\r", "\u00a0"), r"[ \t\r\u00a0]{2,}", " "),
    # sentences end as lines do
    ((), r"([.!?…])\s+", "$1\n"),
)
#: A run of up to four words that is written over and over from a message's begin counts as one.
_OVER = r"^(\S+(?: \S+){0,3}?)(?: \1)+(?!\S)"
_EDGE = " \t\r*#_=~|•·.,:;!?¡¿\"'“”«»()[]<>-–—"
_ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def forms(text: Column) -> Column:
    """The masked messages of a text, in order, without empty ones."""

    def step(c: Column, letters: tuple[str, ...], change) -> Column:
        # a variable of its own for what is masked so far, as it is used more than once
        some = lambda x: reduce(or_, (F.contains(x, F.lit(y)) for y in letters))
        return F.get(F.transform(F.array(c), lambda x: F.when(some(x), change(x)).otherwise(x)), 0)

    t = F.lower(text)
    for letters, pattern, put in MASKS:
        mask = lambda x, pattern=pattern, put=put: F.regexp_replace(x, pattern, put)
        t = step(t, letters, mask) if letters else mask(t)
    t = step(t, ("&",), lambda x: reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, x))
    unit = lambda u: F.regexp_replace(F.btrim(u, F.lit(_EDGE)), _OVER, "$1")
    return F.filter(F.transform(F.split(t, "\n"), unit), lambda u: u != "")


# ------------------------------------------------------------------ phrase and placeholder rules for what recurs

# The standard filler text, and what is typed without thought. A seed word alone makes its document a sample of filler.
SEEDS = ("lorem", "ipsum")
STANDARD = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum".split())
TYPED = frozenset("asdf asdfasdf asdfgh sdfg dfgh fghj ghjk hjkl jkl qwer qwert qwerty qwertz wert zxcv zxcvbn yxcv xcvb foo bar baz qux quux foobar blah bla blub test testing tests xxx yyy zzz lalala dummy".split())
#: Least share of such words in a message of filler, and its least number of words.
FILLER_SHARE, FILLER_WORDS = 0.6, 3
#: A word is filler if so much of its occurrences are in documents with a seed word, and it has so many of them.
COMPANY, COMPANY_LEAST = 0.5, 5

_SCRIPT = r"\b(?:java ?script|js|scripts?|scripting|skripte?|cookies?|noscript|navigateur|navegador|browser)\b"
_SWITCH = (
    r"\b(?:enable[ds]?|activat\w+|active[zr]?|activer|activa|activar|turn(?:ed)? o(?:n|ff)|switch(?:ed)? o(?:n|ff)|allow(?:ed|s)?|disabled|blocked|blocker|require[sd]?|needed|needs?|supports?|supported|support|must be|not (?:work|run|allow|execute)|doesn't (?:work|run|allow|support)|checking your|"
    r"aktivier\w+|deaktivier\w+|einschalten|eingeschaltet|ausgeschaltet|erlaub\w+|erforderlich|benötig\w+|braucht|blockier\w+|autoris\w+|désactiv\w+|activé\w*|requis\w*|nécessaires?|nécessite|bloqué\w*|habilit\w+|desactivad\w+|permit\w+|bloquead\w+|necesari\w+|requier\w+|necesita)\b"
)
_FAULT = (
    r"\b(?:(?:error|fehler|erreur|código)(?: code| nr)?[ :#]*0|0 error|(?:internal|server|database|fatal|parse|syntax|runtime|application|unknown|unexpected|uncaught) (?:server )?(?:error|exception)|interner (?:server)?fehler|serverfehler|erreur (?:interne|serveur)|error interno|^fatal\b|undefined (?:index|variable|offset|method)|traceback|not found|nicht gefunden|introuvable|non trouvée?|no encontrad[oa]|no se encontró|unavailable|nicht verfügbar|nicht erreichbar|indisponible|no disponible|forbidden|unauthori[sz]ed|access (?:is )?denied|zugriff verweigert|accès refusé|acceso denegado|bad request|bad gateway|time-?out|timed out|"
    r"expired|abgelaufen|expiré\w*|caducad\w+|went wrong|schiefgelaufen|schief gegangen|salió mal|could not be (?:found|completed|processed|loaded|displayed)|(?:cannot|can't|can not) be (?:found|displayed|shown|loaded)|could not connect|couldn't connect|unable to (?:connect|load|process)|does not exist|doesn't exist|no longer exists?|existiert nicht|n'existe (?:pas|plus)|no existe|has been (?:deleted|removed|moved)|wurde (?:gelöscht|verschoben|entfernt)|a été (?:supprimée?|déplacée?)|ha sido (?:eliminad[oa]|borrad[oa]|movid[oa])|"
    r"gelöscht|supprimé|try again|come back later|versuchen sie es|réessaye[rz]|inténtelo de nuevo|vuelva a intentar\w*|reload (?:the|this) page|refresh (?:the|this) page|log ?in again|sign in again|too many requests|maintenance|wartungsarbeiten|mantenimiento|out of order|did not (?:answer|respond)|not responding|"
    r"permission to (?:see|view|access|read)|administrators? (?:has|have) been|contact (?:the|your|our) (?:administrators?|webmaster|support|help ?desk)|incident 0|request id|reference (?:number|id|code)|(?:return|back) to the (?:home|start|front) ?page)\b"
)
_STUB = (
    r"\b(?:placeholders?|platzhalter|lorem|todo|tbd|fixme|goes here|comes here|(?:your|the) (?:text|answer|question|content|title|body|description|comment|message) here|(?:replace|overwrite|edit|change) this (?:paragraph|text|line|sentence|placeholder|with)|(?:sample|dummy|filler|example|demo|default) (?:text|content|copy|paragraph|page|post|data|answer|question)|"
    r"(?:beispiel|blind|füll|muster|platzhalter)text|texte (?:de remplissage|d['’]exemple|factice)|faux texte|texto (?:de (?:ejemplo|relleno|prueba|muestra)|simulado)|(?:type|write|enter|put|add|insert) (?:your|a|the|some) (?:\w+ )?(?:text|answer|question|content|title|body|description|comment|message)|coming soon|under construction|to be (?:written|added|announced)|content to follow|heading (?:one|two|three|0))\b"
)
_SCRIPT, _SWITCH, _FAULT, _STUB = (re.compile(x) for x in (_SCRIPT, _SWITCH, _FAULT, _STUB))
#: People speak of themselves or ask when they discuss such messages; a notice speaks to its reader.
_PERSON = re.compile(r"\b(?:i|i'm|i've|my|me|anyone|anybody|somebody|ich|mein\w*|mir|jemand|je|j'ai|mon|ma|mes|quelqu'un|yo|mi|mis|alguien)\b")
#: Who speaks of a thing of theirs discusses it, unless it is the place where the message stands.
_OURS = re.compile(r"\b(?:our|unser\w*|notre|nuestr[oa])\b(?! (?:web ?)?(?:sites?|pages?|boards?|forums?|services?|apps?|shops?|stores?|servers?|seite|server|forum)\b)")
_CODE_LINE = re.compile(r"[;{}]$|^(?:echo|print\w*|let|def|for|if|select|from|where|import|return)\b|\S\s*=\s*\S")
#: What a template says around a placeholder, the longest notice that is one message, and the longest message that is a board's furniture.
FRAME_WORDS, NOTICE_WORDS, FURNITURE_WORDS = 8, 20, 5


def is_residue(form: str) -> bool:
    """Whether a message that recurs widely is residue, by its masked form."""
    if form == FILLER:
        return True
    words = form.split()
    holes = sum(w.startswith(HOLE) for w in words)
    if QUOTED in form or len(words) > NOTICE_WORDS + holes:
        return False
    if holes:
        return len(words) <= FRAME_WORDS + 3 * holes and not _CODE_LINE.search(form)
    if _PERSON.search(form):
        return False
    return bool(_STUB.search(form) or _FAULT.search(form) or _SCRIPT.search(form) and _SWITCH.search(form) and not _OURS.search(form))


# ------------------------------------------------------------------ operator


def _size(form: str) -> Column:
    return F.regexp_count(form, F.lit(r"[\p{L}\p{N}§]+"))


def _filler(messages: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, nth): the messages made of filler words; their words are the standard ones, and those that keep company with them.

    ``messages`` has (key, nth, form) and whether the document has a seed word (seeded). All words of all documents are counted.
    """
    word = F.explode(F.split("form", " ")).alias("word")
    # marks beside the words are taken off where each word is one row, not where it stands
    vocabulary = shelf.put(messages.select("seeded", word).groupBy("word").agg(F.count("*").alias("n"), F.count_if("seeded").alias("s")).withColumn("bare", F.btrim("word", F.lit(".,:;!?"))))
    learned = vocabulary.groupBy("bare").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where((F.col("n") >= COMPANY_LEAST) & (F.col("s") >= COMPANY * F.col("n"))).where("length(bare) > 1 AND bare rlike '^[a-zà-ÿ]+$'").select("bare")
    standard = messages.sparkSession.createDataFrame([(w,) for w in sorted(STANDARD | TYPED)], "bare string")
    lexicon = shelf.put(vocabulary.join(learned.unionByName(standard).distinct(), "bare", "left_semi").select("word"))
    words = F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1
    met = messages.select("key", "nth", "form", words.alias("words")).select("key", "nth", "words", word).join(lexicon, "word").groupBy("key", "nth", "words").agg(F.count("*").alias("n"))
    return met.where((F.col("words") >= FILLER_WORDS) & (F.col("n") >= FILLER_SHARE * F.col("words"))).select("key", "nth")


def find_residue(df: DataFrame, key: str, text: str, source: str, most_content: int = 2, most_words: int = 40, min_docs: int = 8, min_sources: int = 3) -> DataFrame:
    """(key): the documents whose body is residue.

    A message recurs widely if its masked form is in at least ``min_docs`` documents of ``min_sources`` sources. Beside the
    residue may stand ``most_content`` messages that don't recur, of ``most_words`` words in all (a title, a stub sentence), and any
    that do. Null and empty texts are no cases; a null source counts as one source; rows with the same key are one document;
    further columns aren't read. The texts are read once; what is shuffled are hashes, and words combined before the shuffle.
    """
    shelf = Shelf(df.sparkSession)
    own = F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"), own.alias("source")).where("key IS NOT NULL AND length(text) > 0")
    seed = reduce(or_, (F.contains(F.lower("text"), F.lit(x)) for x in SEEDS))
    units = src.select("key", "source", seed.alias("seeded"), F.posexplode(forms(F.col("text"))).alias("nth", "form"))
    messages = shelf.put(units.select("key", "source", "seeded", "nth", "form", F.xxhash64("form").alias("h")))
    filler = shelf.put(_filler(messages, shelf))
    sources = messages.select("key", "source")
    spread = lambda t: t.distinct().groupBy("h", "source").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("docs"), F.count("*").alias("sources")).where((F.col("docs") >= min_docs) & (F.col("sources") >= min_sources))
    wide = spread(messages.select("h", "source", "key"))
    kinds = shelf.put(_classified(messages.select("h", "form").join(wide.select("h"), "h").groupBy("h").agg(F.first("form").alias("form"))))
    # messages of filler have one form, which has to recur as well
    one = filler.select("key").join(sources.distinct(), "key").select(F.lit(0).alias("h"), "source", "key")
    settled = spread(one).count() > 0
    # of what is left only the documents with residue are looked at
    suspects = messages.select("key", "h").join(kinds.where("residue"), "h", "left_semi").select("key")
    if settled:
        suspects = suspects.unionByName(filler.select("key"))
    suspects = shelf.put(suspects.distinct())
    known = messages.select("key", "nth", "h", "form").join(suspects, "key", "left_semi").join(kinds, "h", "left").withColumn("words", _size("form"))
    made = filler.select("key", "nth", F.lit(True).alias("filler")) if settled else filler.select("key", "nth", F.lit(True).alias("filler")).where("false")
    known = known.join(made, ["key", "nth"], "left").withColumn("residue", F.coalesce("filler", "residue"))
    content = F.col("residue").isNull() | ~F.col("residue") & (F.col("words") > FURNITURE_WORDS)
    # a message that a document repeats is one; its words count each time, as they may differ where they are masked
    each = known.select("key", "h", F.coalesce("residue", F.lit(False)).alias("residue"), content.alias("content"), F.when(F.contains("form", F.lit(QUOTED)), most_words + 1).when(content, F.col("words")).otherwise(0).alias("words"))
    each = each.groupBy("key", "h", "residue", "content").agg(F.sum("words").alias("words"))
    judged = each.groupBy("key").agg(F.count_if("residue").alias("residue"), F.count_if("content").alias("content"), F.sum("words").alias("words"))
    found = shelf.put(judged.where((F.col("residue") > 0) & (F.col("content") <= most_content) & (F.col("words") <= most_words)).select(F.col("key").alias(key)))
    shelf.clear(found)
    return found


def _classified(recurring: DataFrame) -> DataFrame:
    """(h, residue) of the recurring forms (h, form): a few for each million messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_residue(f) for f in b.column(1).to_pylist()], pa.bool_())], ["h", "residue"])

    return recurring.mapInArrow(run, "h long, residue boolean")
