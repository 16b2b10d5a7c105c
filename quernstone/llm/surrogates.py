r"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

Kinds: e-mail and IPv4 addresses, phone numbers (area code in parentheses; three, three and four digits; international ones after a +), card
numbers (16 digits, or 13 to 19 that pass the Luhn check), secrets (long hexadecimal strings), and names after an honorific.
One pattern finds them all, left to right. An entity is what its mentions agree in: a card's or a phone's digits however they are grouped
(without the country code, which stays), an address in any case, a surname, a given name with its surname and gender. So mentions
of one entity corefer after it too: `Mr. Karl Smith` and `Mr Smith` keep one surname. A surrogate is a function of key, kind and
entity, drawn character by character: a digit for a digit, in secrets a hexadecimal one, a letter for a letter of the same
script, in surnames a vowel for a vowel; the mention lends case and separators. Cards that pass the Luhn check pass it after; octets stay under
256; domains are entities of their own, so that addresses that share one still do, and keep their last label; given names come from lists by
gender (told by the honorific) and script (Latin, Cyrillic, Greek; other scripts get Latin letters).

Collision checks: within its scope (a kind; a domain for local parts, a surname for given names) no two entities share a surrogate, and none is
itself an entity of the corpus. All get a candidate; of those that share one, the least entity keeps it, the others draw again. Formats are
counted first: where entities are over a quarter of what a format can hold, its length gives way at once (a longer local part, domain, number,
secret or surname, a second given name, octets of any length), as it does for an entity that has lost ROUNDS draws.
So each draw succeeds with a fair chance, rounds grow with the logarithm of the entities, and full formats end too. Over 2^30
distinct IPv4 addresses are mapped by a keyed permutation: distinct, but maybe another real one.
Entities are pre-aggregated: each surrogate is drawn once, however often its entity stands. Texts without entities never move;
those with some meet their surrogates by (id, hash of the text), in a broadcast while these are few.

Null texts stay null; rows without entities stay as they are. Rows that share id and text share a result.
Empty tables give empty results. Other columns stay (columns named like added ones are replaced). Keys are secrets: pass your own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.base import BROADCAST_ROWS, cut, small

# Patterns by kind, in the order in which they are tried at a place.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+?(?<![0-9A-Za-z])(?:[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,11})){1,6}(?![0-9])"
CARD = r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
GROUPS = r"(?<![0-9A-Za-z.+-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{16,64}(?![0-9A-Za-z])"
# Honorifics by gender, and given names that replace others, by script and gender.
MALE, FEMALE, EITHER = ["Mr", "Herr", "Monsieur", "Señor"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"], ["Dr", "Prof"]
NAMES = {
    "latin": {
        "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Martin", "Noel", "Oscar", "Paul"],
        "f": ["Ada", "Beate", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"],
    },
    "cyrillic": {
        "m": ["Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей"],
        "f": ["Алина", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита", "София"],
    },
    "greek": {
        "m": ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Κώστας", "Λάμπρος", "Μάριος", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος", "Στέφανος", "Τάσος", "Φίλιππος"],
        "f": ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Ξένια", "Ρένα", "Σοφία", "Χαρά"],
    },
}
NAME = r"\b(?:" + "|".join(MALE + FEMALE + EITHER) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
PATTERN = "|".join((MAIL, PHONE, ABROAD, CARD, IP, GROUPS, SECRET, NAME))
#: Without one of these a text has no entity; far cheaper to look for.
HINT = r"[0-9@]|(?:" + "|".join(x[:3] for x in MALE + FEMALE + EITHER) + ")"
# Alphabets, in small letters by script; those of surnames by vowels and consonants; those of secrets.
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "àâäáçéèêëíîïñóôöúùûü", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщыэюя", "0123456789"]
SOUNDS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "àâäáéèêëíîïóôöúùûü", "çñ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь"]
HEX = ["0123456789", "abcdef", "ABCDEF"]
#: What a wider surname ends in, by script.
ENDS = {"latin": "anarin", "cyrillic": "анарин", "greek": "αναριν"}
ADDED = ("n_entities",)
#: Draws in an entity's format; of a format's candidates, the part that entities may take.
ROUNDS, ROOM, MANY_IPS = 8, 4, 1 << 30
SEP = "\u0001"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_rest(digits: Column) -> Column:
    """What the digits of a number lack to a Luhn sum of 10, given as an array of ints with the check digit as 0."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10))


def ints(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def kind(m: Column) -> Column:
    """Null for numbers that only look like a card or a phone."""
    n = F.length(digits_of(m))
    card = F.when((n == 16) | (luhn_rest(ints(digits_of(m))) == 0), "card")
    return (
        F.when(m.contains("@"), "mail").when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip").when(m.startswith("+") & ~m.contains("("), F.when(n.between(8, 15), "phone"))
        .when(m.contains("(") | m.rlike("^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone").when(m.rlike("^[0-9 -]+$"), card).when(m.contains(" "), "name").otherwise("secret")
    )


def script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def gender(title: Column) -> Column:
    of = lambda titles: title.rlike("^(?:" + "|".join(titles) + r")\.?$")
    return F.when(of(FEMALE), "f").when(of(MALE), "m").otherwise("x")


def country(m: Column) -> Column:
    """What of a phone number stays: the country code and what follows it."""
    return F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])[ .-]?|[0-9]{1,3}[ -]?(?=\())", 1)


def parts(m: Column) -> dict[str, Column]:
    """By kind of part: the entity that a mention names, as all its mentions write it."""
    domain = F.lower(F.substring_index(m, "@", -1))
    last, given = F.lower(F.element_at(F.split(m, " "), -1)), F.element_at(F.split(m, " "), 2)
    return {
        "local": F.concat(F.lower(F.substring_index(m, "@", 1)), F.lit("@"), domain), "domain": domain, "ip": m, "phone": digits_of(F.substring(m, F.length(country(m)) + 1, F.length(m))),
        "card": digits_of(m), "secret": m, "surname": last, "given": F.concat_ws(SEP, gender(F.element_at(F.split(m, " "), 1)), script(given), F.lower(given), last),
    }


def entities_of(m: Column) -> Column:
    """array<struct<kind, entity>> that a mention consists of."""
    p, k = parts(m), kind(m)
    one = lambda *names: F.array(*[F.struct(F.lit(n).alias("kind"), p[n].alias("entity")) for n in names])
    out = F.when(k == "mail", one("local", "domain")).when((k == "name") & (F.size(F.split(m, " ")) > 2), one("surname", "given")).when(k == "name", one("surname"))
    for name in ("ip", "phone", "card", "secret"):
        out = out.when(k == name, one(name))
    return F.coalesce(out, F.array().cast("array<struct<kind:string,entity:string>>"))


def draw(stream: Column, i: Column, n: int | Column) -> Column:
    """A number under n, from a keyed hash at place i."""
    return F.pmod(F.xxhash64(stream, i), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")).cast("int")


def alike(text: Column, stream: Column, alphabets: list[str], other: str | None = LETTERS[0], first: int = 0) -> Column:
    """Each character replaced by one of its alphabet; letters of none by one of `other`. Draws are numbered from `first`."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c == "", c)
        for a in alphabets:
            out = out.when(F.lit(a).contains(c), F.substr(F.lit(a), draw(stream, i + first, len(a)) + 1, F.lit(1)))
        if other:
            out = out.when(c.rlike(r"\p{L}"), F.substr(F.lit(other), draw(stream, i + first, len(other)) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def room(text: Column, alphabets: list[str]) -> tuple[Column, Column]:
    """(the format of a text, the logarithm of what it can hold)."""

    def of(c: Column, found: list, other) -> Column:
        out = F.when(c == "", other)
        for a, x in zip(alphabets, found, strict=True):
            out = out.when(F.lit(a).contains(c), x)
        return out.when(c.rlike(r"\p{L}"), found[0]).otherwise(other)

    chars = F.split(text, "")
    size = F.aggregate(chars, F.lit(0.0), lambda n, c: n + of(c, [F.lit(math.log(len(a))) for a in alphabets], F.lit(0.0)))
    return F.array_join(F.transform(chars, lambda c: of(c, [F.lit(chr(0x2460 + k)) for k in range(len(alphabets))], c)), ""), size


def stem(domain: Column) -> Column:
    return F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)


def of_kind(k: Column, found: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), next(iter(found.values())))
    for name, x in found.items():
        out = out.when(k == name, x)
    return out


def formats(k: Column, entity: Column) -> tuple[Column, Column, Column]:
    """(format, logarithm of what it holds, logarithm of what each further length multiplies that by)."""
    local, domain = room(F.substring_index(entity, "@", 1), LETTERS), room(stem(entity), LETTERS)
    secret, surname, number = room(entity, HEX), room(entity, SOUNDS), room(entity, ["0123456789"])
    lengths = F.transform(F.split(entity, r"\."), lambda o: F.length(o))
    octets = F.aggregate(lengths, F.lit(0.0), lambda n, x: n + F.when(x == 1, 2.302585).when(x == 2, 4.499810).otherwise(5.049856))
    g = F.split(entity, SEP)
    named = F.when(g[0] == "x", 3.465736).otherwise(2.772589)
    names = F.concat_ws(SEP, g[0], g[1], g[3])
    fmt = of_kind(k, {"local": F.concat(local[0], F.lit("@"), F.substring_index(entity, "@", -1)), "domain": F.concat(domain[0], F.lit("."), F.substring_index(entity, ".", -1)), "ip": F.array_join(lengths.cast("array<string>"), "."), "phone": number[0], "card": F.concat(number[0], luhn_rest(ints(entity)).cast("string")), "secret": secret[0], "surname": surname[0], "given": names})
    size = of_kind(k, {"local": local[1], "domain": domain[1], "ip": octets, "phone": number[1], "card": number[1] - 2.302585, "secret": secret[1], "surname": surname[1], "given": named})
    more = of_kind(k, {"local": F.lit(3.258097), "domain": F.lit(3.258097), "ip": 22.18071 - octets, "phone": F.lit(2.302585), "card": F.lit(2.302585), "secret": F.lit(2.302585), "surname": F.lit(0.693147), "given": named})
    return fmt, size, more


def drawn(rows: DataFrame, key: Column) -> DataFrame:
    """rows (kind, entity, width, attempt) with scope and s, the surrogate, in small letters; width: by how much its format is longer."""
    k, entity, st, body, wide = F.col("kind"), F.col("entity"), F.col("st"), F.col("body"), F.col("wide")
    kept = [c for c in rows.columns if c not in ("scope", "s")]
    end = F.when(script(entity) == "cyrillic", ENDS["cyrillic"]).when(script(entity) == "greek", ENDS["greek"]).otherwise(ENDS["latin"])
    tail = F.when(k.isin("local", "domain"), F.repeat(F.lit("a"), wide)).when(k == "surname", F.substring(F.repeat(end, (wide / 6 + 1).cast("int")), F.lit(1), wide)).otherwise(F.repeat(F.lit("0"), wide))
    rows = rows.select(
        *kept, scope(k, entity).alias("scope"), F.sha2(F.concat_ws(SEP, key, k, entity, F.col("attempt").cast("string")), 256).alias("st"),
        (F.col("width") + F.greatest(F.lit(0), F.col("attempt") - ROUNDS)).cast("int").alias("wide"),
        F.when(k == "local", F.substring_index(entity, "@", 1)).when(k == "domain", stem(entity)).when(k.isin("ip", "given"), "").otherwise(entity).alias("body"),
    )
    rows = rows.select("*", tail.alias("tail"))
    own = F.when(k == "secret", alike(body, st, HEX, None)).when(k == "surname", F.concat(alike(body, st, SOUNDS), alike(F.col("tail"), st, SOUNDS, first=1000))).otherwise(alike(F.concat(body, F.col("tail")), st, LETTERS))
    rows = rows.select("*", own.alias("own"))
    own = F.col("own")
    octets = F.transform(F.split(entity, r"\."), lambda o, i: F.when(wide > 0, draw(st, i, 256)).when(F.length(o) == 1, draw(st, i, 10)).when(F.length(o) == 2, 10 + draw(st, i, 90)).otherwise(100 + draw(st, i, 156)).cast("string"))
    cut_ = F.substring(own, F.lit(1), F.length(own) - 1)
    card = F.when(luhn_rest(ints(entity)) == 0, F.concat(cut_, luhn_rest(F.concat(ints(cut_), F.array(F.lit(0)))).cast("string"))).otherwise(own)
    g = F.split(entity, SEP)
    names = of_kind(F.concat(g[1], F.lit(" "), g[0]), {f"{script} {sex}": F.array(*[F.lit(x) for x in (lists[sex] if sex != "x" else lists["m"] + lists["f"])]) for script, lists in NAMES.items() for sex in ("m", "f", "x")})
    given = F.array_join(F.transform(F.sequence(F.lit(0), wide), lambda i: F.element_at(names, draw(st, i, F.size(names)) + 1)), "-")
    s = F.when(k == "domain", F.concat(own, F.lit("."), F.substring_index(entity, ".", -1))).when(k == "ip", F.array_join(octets, ".")).when(k == "card", card).when(k == "secret", F.concat(own, alike(F.col("tail"), st, HEX, None, first=1000))).when(k == "given", given).otherwise(own)
    return rows.select(*kept, "scope", s.alias("s"))


def permuted(ip: Column, key: Column) -> Column:
    """A keyed permutation of all IPv4 addresses."""
    octet = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    left, right = octet(1) * 256 + octet(2), octet(3) * 256 + octet(4)
    for i in range(4):
        left, right = right, left.bitwiseXOR(F.pmod(F.xxhash64(key, F.lit(i), right), F.lit(65536)))
    return F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(255).cast("string") for x in (left, right) for s in (8, 0)])


def widths(entities: DataFrame) -> DataFrame:
    """kind, entity, width: by how much longer formats must be that hold too many entities."""
    fmt, size, more = formats(F.col("kind"), F.col("entity"))
    rows = entities.select("kind", "entity", fmt.alias("fmt"), size.alias("size"), more.alias("more"))
    crowded = rows.groupBy("kind", "fmt").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("more").alias("more"))
    lack = F.log(F.lit(float(ROOM)) * F.col("n")) - F.col("size")
    width = F.when(F.col("kind") == "ip", F.when(lack > 0, 1)).otherwise(F.ceil(lack / F.greatest("more", F.lit(0.5))))
    crowded = crowded.where(lack > 0).select(F.col("kind").alias("c_kind"), F.col("fmt").alias("c_fmt"), width.cast("int").alias("width"))
    joined = rows.join(small(crowded, crowded.count()), (F.col("kind") == F.col("c_kind")) & (F.col("fmt") == F.col("c_fmt")), "left")
    return joined.select("kind", "entity", F.coalesce("width", F.lit(0)).alias("width"))


def scope(k: Column, entity: Column) -> Column:
    """Within what surrogates must differ."""
    return F.when(k == "local", F.substring_index(entity, "@", -1)).when(k == "given", F.substring_index(entity, SEP, -1)).otherwise("")


def settled(entities: DataFrame, key: Column) -> DataFrame:
    """kind, entity, s of all entities (kind, entity)."""
    state = cut(drawn(widths(entities).withColumn("attempt", F.lit(0)), key))
    named = F.col("kind").isin("local", "given")  # no real one has a surrogate's domain or surname
    real = state.where(~named).select("kind", F.col("entity").alias("s"), F.lit(True).alias("real"))
    while True:
        holders = state.groupBy("kind", "scope", "s").agg(F.min(F.struct("attempt", "entity")).alias("holder"), F.count("*").alias("n"))
        lost = cut(holders.join(real, ["kind", "s"], "left").where("n > 1 or real").select("kind", "scope", "s", "holder", F.coalesce("real", F.lit(False)).alias("real")))
        n = lost.count()
        if n == 0:
            return state.select("kind", "entity", "s")
        moves = F.col("real") | ((F.col("attempt") != F.col("holder.attempt")) | (F.col("entity") != F.col("holder.entity")))
        marked = state.join(small(lost, n), ["kind", "scope", "s"], "left").withColumn("moves", F.col("real").isNotNull() & moves)
        again = drawn(marked.where("moves").select("kind", "entity", "width", (F.col("attempt") + 1).alias("attempt")), key)
        state = cut(marked.where("not moves").select(*again.columns).unionByName(again))


def cased(model: Column, word: Column) -> Column:
    """word with capitals where the model has them; all in capitals if the model is."""
    whole = (F.upper(model) == model) & (F.lower(model) != model) & (F.length(model) > 1)
    chars = F.zip_with(F.split(word, ""), F.split(model, ""), lambda w, m: F.when((m != F.lower(m)), F.upper(w)).otherwise(F.coalesce(w, F.lit(""))))
    return F.when(whole, F.upper(word)).otherwise(F.array_join(chars, ""))


def filled(model: Column, digits: Column) -> Column:
    """The digits in the places of the model's digits; those left over stand at the end."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    done = F.aggregate(F.split(model, ""), start, put)
    return F.concat(done["out"], F.substr(digits, done["at"], F.greatest(F.lit(0), F.length(digits) - done["at"] + 1)))


def rendered(m: Column, found: Column, key: Column, many_ips: bool = False) -> Column:
    """What stands for a mention. found: map of kind and entity to surrogates."""
    p = parts(m)
    new = lambda name: F.try_element_at(found, F.concat_ws(SEP, F.lit(name), p[name]))
    words = F.split(m, " ")
    title, last = F.element_at(words, 1), cased(F.element_at(words, -1), new("surname"))
    given = F.when(F.upper(F.element_at(words, 2)) == F.element_at(words, 2), F.upper(new("given"))).otherwise(new("given"))
    mail = F.concat(cased(F.substring_index(m, "@", 1), new("local")), F.lit("@"), new("domain"))
    phone = F.concat(country(m), filled(F.substring(m, F.length(country(m)) + 1, F.length(m)), new("phone")))
    name = F.when(F.size(words) > 2, F.concat_ws(" ", title, given, last)).otherwise(F.concat_ws(" ", title, last))
    return F.coalesce(of_kind(kind(m), {"mail": mail, "ip": permuted(m, key) if many_ips else new("ip"), "phone": phone, "card": filled(m, new("card")), "secret": new("secret"), "name": name}), m)


def replace(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with entities in its text replaced, and n_entities."""
    own = ("pii_text", "pii_found", "pii_id", "pii_hash", "pii_s")
    names = {c: f"aside_{i}" for i, c in enumerate(df.columns) if c.lower() in own}
    df = df.drop(*[c for c in df.columns if c.lower() in ADDED]).withColumnsRenamed(names)
    body, secret_key = F.col(f"`{text}`").cast("string"), F.lit(secret)
    docs = df.withColumn("pii_text", body).withColumn("pii_found", F.when(F.col("pii_text").rlike(HINT), F.regexp_extract_all("pii_text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("pii_id", F.col(f"`{key}`")).withColumn("pii_hash", F.xxhash64("pii_text"))
    mentions = docs.where(F.size("pii_found") > 0).select("pii_id", "pii_hash", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("pii_found"), entities_of)))).alias("e"))
    mentions = cut(mentions.select("pii_id", "pii_hash", "e.*").distinct())
    entities = mentions.select("kind", "entity").distinct()
    many_ips = entities.where("kind = 'ip'").count() > MANY_IPS
    new = settled(entities.where("kind != 'ip'") if many_ips else entities, secret_key)
    found = mentions.join(small(new, new.count()), ["kind", "entity"])
    found = cut(found.groupBy("pii_id", "pii_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(SEP, "kind", "entity").alias("k"), F.col("s").alias("v")))).alias("pii_s")).withColumnsRenamed({"pii_id": "f_id", "pii_hash": "f_hash"}))
    size = found.agg(F.sum(F.size("pii_s"))).first()[0] or 0
    some = docs.where(F.size("pii_found") > 0).join(small(found, size), (F.col("pii_hash") == F.col("f_hash")) & F.col("pii_id").eqNullSafe(F.col("f_id")), "left")
    replaced = F.transform("pii_found", lambda m: rendered(m, F.col("pii_s"), secret_key, many_ips))
    joined = F.array_join(F.zip_with(F.split("pii_text", PATTERN, -1), replaced, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    n_entities = F.size(F.filter("pii_found", lambda m: kind(m).isNotNull())).cast("long")
    if size > BROADCAST_ROWS:  # texts without entities don't take part in the shuffle
        some = some.select(*[F.col(f"`{c}`") if c != text else joined.alias(text) for c in df.columns], n_entities.alias("n_entities"))
        rest = docs.where("size(pii_found) = 0 or pii_found is null").select(*[F.col(f"`{c}`") if c != text else F.col("pii_text").alias(text) for c in df.columns], F.lit(0).cast("long").alias("n_entities"))
        out = some.unionByName(rest)
    else:
        all_ = docs.join(F.broadcast(found), (F.col("pii_hash") == F.col("f_hash")) & F.col("pii_id").eqNullSafe(F.col("f_id")), "left")
        changed = F.when(F.col("pii_s").isNotNull(), joined).otherwise(F.col("pii_text"))
        out = all_.select(*[F.col(f"`{c}`") if c != text else changed.alias(text) for c in df.columns], F.coalesce(n_entities, F.lit(0).cast("long")).alias("n_entities"))
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, "an example, not a secret").select("doc_id", "n_entities", "text")
