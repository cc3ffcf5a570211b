"""Surrogates for personal data. DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, payment cards, telephone numbers, hexadecimal secrets, key
tokens and titled personal names. Each distinct entity gets one surrogate everywhere, so that coreference holds: an entity is an
e-mail address or hexadecimal secret in lower case, the bare digits of a number, or one word of a name apart from its title. Letters and
digits come from a keyed hash, with each mention's own case and separators; cards pass the Luhn check,
addresses stay valid. Titles stay; a name word keeps the script, and the gender if all titles right before it agree.
Where a document has a titled name, the words of that name are also replaced wherever they stand without a title. Surrogates that meet one another or a real
entity are drawn again until all are distinct; each draw makes names and e-mail addresses one syllable or letter longer.

Plan: mentions and their entities are made distinct with partial aggregations; drawing again touches only what collided; the mapping
joins the mentions (AQE splits hot entities) and comes back to its documents by one join.

Cases: a null text stays null; texts without entities are unchanged; rows that share a ``doc_id``
are treated alike; a null ``doc_id`` is an id like others; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Titles by gender, and syllables of surrogate names by script and gender.
MALE, FEMALE, NEUTRAL = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|[Гг]-н|[Гг]осподин", r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Señora|Sra\.|[Гг]-жа|[Гг]оспожа", r"Dr\.?|Prof\.?|[Дд]октор|[Дд]-р|[Пп]роф\.|[Пп]рофессор"
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma".split(), "cyrillic": "ба бе бо да де до фа фе га го ха хе жа жо ка ке ла ле ло ма".split()}
ENDINGS = {("latin", "m"): "rt", ("latin", "f"): "na", ("latin", "n"): "li", ("cyrillic", "m"): "р", ("cyrillic", "f"): "на", ("cyrillic", "n"): "ли"}
KINDS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "card": r"\b\d(?:[ \-]?\d){12,18}\b",
    "phone": r"(?:\+\d{1,3}[ \-]?)?(?:\(\d{3}\)[ \-]?|\b\d{3}[ \-.])\d{3}[\-. ]\d{4}\b",
    "secret": r"\b[0-9a-fA-F]{32,128}\b",
    "token": r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xoxb)[_\-][A-Za-z0-9]{16,})\b",
    "name": rf"(?<![\p{{L}}\p{{N}}_])(?:{FEMALE}|{MALE}|{NEUTRAL}) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A word that may be a name without its title.
BARE = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}+(?![\p{L}\p{N}_])"
ROUNDS = 64
#: Two control characters: what parts a text's mentions, and what stands for such a character of the text (and is itself doubled there).
MARK, HOLD = "\u0001", "\u0002"


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind) if out is None else out.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return out


def stream(key: str, entity: Column, attempt: Column) -> Column:
    """Hexadecimal digits that only the key's holder can draw, as many as the entity has characters at least."""
    block = lambda n: F.sha2(F.concat_ws("\u0000", F.lit(key), F.lit(str(n)), attempt.cast("string"), entity), 256)
    return F.concat(block(0), block(1), F.repeat(block(2), F.ceil(F.length(entity) / 64).cast("int")))


def number(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 8), 16, 10).cast("long")


def like(entity: Column, digits: Column) -> Column:
    """Each letter and digit from the stream, with the entity's case and separators."""
    letters, decimals = F.translate(digits, "0123456789abcdef", "etaoinshrdlucmfw"), F.translate(digits, "abcdef", "394716")

    def one(c: Column, i: Column) -> Column:
        letter, digit = F.substr(letters, i + 1, F.lit(1)), F.substr(decimals, i + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def luhn(card: Column) -> Column:
    """The card with a last digit that makes it valid."""
    plain = F.reverse(F.regexp_replace(F.substr(card, F.lit(1), F.length(card) - 1), "[^0-9]", ""))

    worth = F.transform(F.split(plain, ""), lambda c, i: F.when(i % 2 == 0, F.floor(2 * c.cast("int") / 10) + 2 * c.cast("int") % 10).otherwise(c.cast("int")).cast("int"))
    last = (10 - F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10) % 10
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), last.cast("string"))


def title_of(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^(?:{FEMALE}|{MALE}|{NEUTRAL})(?= )", 0)


def gender_of(title: Column) -> Column:
    return F.when(title.rlike(f"^(?:{FEMALE})$"), "f").when(title.rlike(f"^(?:{MALE})$"), "m")


def name_like(word: Column, gender: Column, digits: Column, extra: int = 0) -> Column:
    """A new name in the same script and of the gender; ``extra`` more syllables make more names."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    values = [number(digits, 1 + 8 * k) for k in range(3)] + [number(F.sha2(F.concat(digits, F.lit(f" {k}")), 256), 1) for k in range(extra)]
    out = None
    for s, parts in SYLLABLES.items():
        table = F.array(*map(F.lit, parts))
        made = F.initcap(F.concat(*[F.get(table, (x % len(parts)).cast("int")) for x in values]))
        out = F.when(script == s, made) if out is None else out.when(script == s, made)
    ending = F.coalesce(*[F.when((script == s) & (gender == g), e) for (s, g), e in ENDINGS.items()])
    return F.concat(out, ending)


def surrogate(kind: Column, entity: Column, gender: Column, digits: Column, extra: int = 0) -> Column:
    """The surrogate of a draw; ``extra`` makes names and e-mail addresses, which may be short, longer, so that none run out."""
    more = F.translate(F.substring(F.sha2(digits, 256), 1, extra), "0123456789abcdef", "etaoinshrdlucmfw")
    top = F.regexp_extract(entity, r"\.[A-Za-z]+$", 0)
    email = F.concat(more, like(F.substr(entity, F.lit(1), F.length(entity) - F.length(top)), digits), top)
    ip = F.concat_ws(".", (number(digits, 1) % 223 + 1).cast("string"), *[(number(digits, 8 * k + 1) % 254 + 1).cast("string") for k in (1, 2, 3)])
    decimals = F.translate(digits, "abcdef", "394716")
    card = luhn(F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.when(i == 0, "4").otherwise(F.substr(decimals, i + 1, F.lit(1)))).otherwise(c)), ""))
    secret = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.substr(digits, i + 1, F.lit(1))), "")
    prefix = F.regexp_extract(entity, r"^(?:AKIA|(?:sk|pk|ghp|xoxb)[_\-])", 0)
    token = F.concat(prefix, like(F.substr(entity, F.length(prefix) + 1), digits))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "secret", secret)
        .when(kind == "token", token).when(kind == "name", name_like(entity, gender, digits, extra)).otherwise(like(entity, digits))
    )


def entities_of(mentions: DataFrame) -> DataFrame:
    """Distinct mentions with kind, and for each of their entities: entity, place ``at`` and the gender of a title right before it."""
    mention, kind = F.col("mention"), F.col("kind")
    words = F.split(F.substr(mention, F.length(title_of(mention)) + 2), " ")
    one = F.when(kind.isin("email", "secret"), F.lower(mention)).when(kind.isin("card", "phone"), F.regexp_replace(mention, "[^0-9]", "")).otherwise(mention)
    out = mentions.select("mention").distinct().withColumn("kind", kind_of(mention))
    out = out.select("mention", "kind", F.posexplode(F.when(kind == "name", words).otherwise(F.array(one))).alias("at", "entity"))
    return out.withColumn("gender", F.when((kind == "name") & (F.col("at") == 0), gender_of(title_of(mention))))


def rendered(mention: Column, kind: Column, drawn: Column) -> Column:
    """The mention with the surrogate of its entity (of its words, in order) in its own case and separators."""
    first = drawn[0]
    shift = F.length(first) - F.length(mention)
    upper = lambda i: (i >= shift) & F.substr(mention, F.greatest(i - shift, F.lit(0)) + 1, F.lit(1)).rlike(r"\p{Lu}")
    email = F.array_join(F.transform(F.split(first, ""), lambda c, i: F.when(upper(i), F.upper(c)).otherwise(c)), "")
    digit = lambda i: F.substr(first, F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))
    digits = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).otherwise(c)), "")
    secret = F.when(mention.rlike("[A-F]"), F.upper(first)).otherwise(first)
    name = F.concat_ws(" ", title_of(mention), F.array_join(drawn, " "))
    return F.when(kind == "email", email).when(kind.isin("card", "phone"), digits).when(kind == "secret", secret).when(kind == "name", name).otherwise(first)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities (kind, entity, gender); no two surrogates are equal and none is an entity."""
    pending = materialize(entities)
    known = pending.select(F.col("entity").alias("surrogate")).distinct()
    done = None
    for attempt in range(ROUNDS):
        drawn = materialize(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), stream(key, F.col("entity"), F.lit(attempt)), attempt)))
        taken = known if done is None else known.unionByName(done.select("surrogate"))
        winner = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("w")).select("surrogate", "w.*").join(taken, "surrogate", "left_anti")
        good = materialize(drawn.join(winner, ["surrogate", "kind", "entity"], "left_semi").select("kind", "entity", "surrogate"))
        done = good if done is None else done.unionByName(good)
        pending = drawn.drop("surrogate").join(good, ["kind", "entity"], "left_anti")
        if pending.isEmpty():
            return done
        pending = materialize(pending)
    raise ValueError(f"no distinct surrogates after {ROUNDS} draws")


def surrogates(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", found: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of mentions in ``found``."""
    mentions = materialize(
        docs.where(F.col(text).rlike(ANY)).select(F.col(id).alias("__id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).alias("mention")).distinct()
    )
    parts = materialize(entities_of(mentions))
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    names = mapping(parts.groupBy("kind", "entity").agg(F.coalesce(agreed, F.lit("n")).alias("gender")), key)
    words = F.sort_array(F.collect_list(F.struct("at", "entity", "surrogate")))
    shown = parts.join(names, ["kind", "entity"]).groupBy("mention", "kind").agg(words.alias("w"))
    bare = F.when(F.col("kind") == "name", F.transform("w", lambda x: F.struct(x["entity"].alias("k"), x["surrogate"].alias("v"))))
    shown = shown.select("mention", rendered(F.col("mention"), F.col("kind"), F.col("w.surrogate")).alias("shown"), bare.alias("bare"))
    own = mentions.join(shown, "mention").groupBy("__id").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias("__names"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("__bare")
    )
    joined = docs.drop(found).join(own, docs[id].eqNullSafe(own["__id"]), "left")
    # each mention goes between marks; a mark in the text itself is doubled first, so that it comes back
    marked = F.regexp_replace(F.replace(F.replace(F.col(text), F.lit(HOLD), F.lit(HOLD * 2)), F.lit(MARK), F.lit(MARK + HOLD + MARK)), F.lit(f"({ANY})"), F.lit(f"{MARK}$1{MARK}"))
    # what is no mention is parted again at words that may be names found in this document
    loose = lambda x: F.split(F.regexp_replace(x, f"({BARE})", f"{MARK}$1{MARK}"), MARK)
    split = F.transform(F.split(marked, MARK), lambda x: F.when(F.map_contains_key("__names", x) | (F.size("__bare") == 0), F.array(x)).otherwise(loose(x)))
    value = lambda x: F.coalesce(F.try_element_at("__names", x), F.try_element_at("__bare", x))
    changed = F.array_join(F.transform("__parts", lambda x: F.when(x == HOLD, MARK).otherwise(F.coalesce(value(x), F.replace(x, F.lit(HOLD * 2), F.lit(HOLD))))), "")
    cut = joined.withColumn("__parts", F.when(F.col("__names").isNotNull(), F.flatten(split)))
    out = cut.withColumn(text, F.when(F.col("__names").isNull(), F.col(text)).otherwise(changed))
    count = F.size(F.filter("__parts", lambda x: value(x).isNotNull()))
    return out.withColumn(found, F.when(F.col("__names").isNull(), F.lit(0)).otherwise(count).cast("long")).select(*docs.drop(found).columns, found)
