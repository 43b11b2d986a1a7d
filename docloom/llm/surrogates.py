"""Personal data replaced by surrogates, in DataFrame functions only.

Entities are found by one expression. Each is made of atoms (a given name, a surname, a whole address or number); an
atom's surrogate follows from a secret key, its kind and its value alone, so the same person keeps one surrogate in all
documents, and it has the atom's gender, script and format. Over the distinct atoms, surrogates that meet each other
or a real value are found by grouping, and those atoms try again until all are distinct.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: The secret key is read from this setting of the session; the demo key only stands in on a local master, as in tests.
KEY_SETTING, DEMO_KEY = "spark.docloom.surrogateKey", "docloom-demo-key"
#: Titles by gender, given names that mark a person without a title, and syllables for new names. Fixed values.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Doña", "Señora", "г-жа", "госпожа"]
MALE_TITLES = ["Mr", "Herr", "M", "Sr", "Don", "Señor", "г-н", "господин"]
OTHER_TITLES = ["Dr", "Prof"]
FEMALE_NAMES = ["Mary", "Anna", "Maria", "Emma", "Laura", "Sarah", "Julia", "Sophie", "Claire", "Elena", "Carmen", "Lucia", "Ingrid", "Monika", "Jane", "Linda", "Susan", "Alice", "Marie", "Ana", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Jessica", "Karen", "Lisa", "Nancy", "Margaret", "Sandra", "Emily", "Michelle", "Amanda", "Rebecca", "Helen", "Katherine", "Olivia", "Sabine", "Petra", "Ursula", "Renate", "Heike", "Katharina", "Hannah", "Lena", "Lea", "Nina", "Isabelle", "Nathalie", "Sylvie", "Camille", "Chloe", "Manon", "Isabel", "Pilar", "Dolores", "Teresa", "Rosa", "Marta", "Cristina", "Aylin", "Fatma", "Elif", "Zeynep", "Leyla", "Fatima", "Aisha", "Giulia", "Chiara", "Francesca", "Ewa", "Agnieszka", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина"]
MALE_NAMES = ["John", "James", "Peter", "Paul", "Michael", "Thomas", "David", "Robert", "William", "Pierre", "Jean", "Luis", "Carlos", "Jose", "Hans", "Karl", "Stefan", "Juan", "Bob", "Richard", "Joseph", "Charles", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "Joshua", "Kevin", "Brian", "George", "Edward", "Ronald", "Timothy", "Jason", "Jeffrey", "Ryan", "Jacob", "Nicholas", "Eric", "Jonathan", "Kurt", "Jonas", "Klaus", "Werner", "Walter", "Wolfgang", "Jürgen", "Dieter", "Andreas", "Markus", "Matthias", "Lukas", "Felix", "Maximilian", "Philippe", "Michel", "Alain", "Jacques", "Antoine", "Julien", "Nicolas", "Miguel", "Javier", "Pedro", "Alejandro", "Manuel", "Antonio", "Francisco", "Mehmet", "Mustafa", "Ahmed", "Mohammed", "Omar", "Marco", "Giovanni", "Piotr", "Krzysztof", "Иван", "Пётр", "Сергей", "Борис", "Алексей", "Дмитрий", "Николай"]
#: Words that are surnames too, but mostly stand for months, days or something else; words before a noun. Fixed values.
COMMON = ["May", "April", "June", "August", "March", "Monday", "Friday", "Sunday", "Will", "Young", "Long", "Best", "Rich", "King", "Price", "Rose", "Day", "Love", "Field", "Stone", "Wood", "West", "North", "Church", "Page", "Park", "Green", "Brown", "White", "Black", "Gray", "Case", "Cook", "Baker", "Hall", "Hill", "Major", "Summer", "Winter", "Mai", "Juni", "Juli", "März", "Januar", "Oktober", "Freitag", "Sonntag", "Montag", "Kaiser", "König", "Berg", "Stein", "Wald", "Bach", "Sommer", "Herbst", "Mars", "Avril", "Petit", "Grand", "Mayo", "Abril", "Julio", "Domingo", "Rey", "Campo"]
BEFORE_NOUNS = ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "im", "am", "zum", "zur", "kein", "keine", "the", "a", "an", "le", "la", "les", "un", "une", "el", "los", "las", "una"]
LATIN = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "ve"]
CYRILLIC = ["ба", "бе", "бо", "ва", "ве", "да", "де", "до", "за", "зе", "ка", "ке", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "ра", "ре", "ри", "ро", "са", "се", "та", "те"]
_CYRILLIC_LOW, _CYRILLIC_UP = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"

#: Possessive at the end, as a greedy group takes stack for each of its rounds, and a domain may have any number of labels.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)++"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: A number ends where no other number goes on behind a dot or hyphen, if it can, so it takes no part of its neighbour.
_END = r"(?!\w|[.-]\d)"
_GROUPS = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\w)"


def _ended(body: str) -> str:
    return rf"(?:{body}{_END}|{body}(?!\w))"


_IBAN = rf"(?<!\w)(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?!\w)|{_ended(r'[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?')})"
_NEXT = rf"(?![ -]{_IP})"
_OTHER = rf"(?![ -](?:{_IP}|{_GROUPS}|{_SSN}|\d{{13,19}}(?!\w)))"
_LOCAL = rf"(?:\+\d{{1,3}}{_NEXT}[ .-]?)?(?:\(\d{{2,4}}\)|\d{{2,4}}){_NEXT}[ .-]?\d{{3,4}}{_NEXT}[ .-]\d{{3,4}}(?:{_OTHER}[ .-]\d{{2,4}})?"
_ABROAD = rf"\+(?=(?:[ .()-]{{0,2}}\d){{8}})\d{{1,3}}{_NEXT}[ .-]?\(?\d{{2,8}}\)?(?:{_OTHER}[ .-]?\(?\d{{2,8}}\)?){{0,4}}"
_PHONE = rf"(?<![\w+])(?:{_ended(_LOCAL)}|{_ABROAD}(?!\w))"
_CARD = rf"(?<![\w-])(?:{_GROUPS}(?:{_OTHER}[ -]\d{{1,3}}{_END})?|{_ended(rf'\d(?:{_NEXT}[ -]?\d){{12,18}}')})"
_SECRET = r"(?<!\p{L})(?i:passwo?r?d|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}"
_WORD = r"\p{Lu}\p{Ll}+"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


_TITLE = _any(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_NAME = rf"(?<!\p{{L}})(?:{_TITLE}\.? {_WORD}(?:(?! {_TITLE}\.? \p{{Lu}})[ -]{_WORD}){{0,2}}|{_any(FEMALE_NAMES + MALE_NAMES)} {_WORD}(?!\p{{L}}))"
#: Each kind behind a look at its first character, so most places of a text are passed at once.
_MARKED = [rf"(?=[pPtTsSaA]){_SECRET}", rf"(?=[\d+(])(?:{'|'.join([_IP, _SSN, _CARD, _PHONE])})", rf"(?=[A-Z]{{2}}\d{{2}}){_IBAN}", rf"(?=[\p{{Lu}}г]){_NAME}"]
PLAIN = "|".join(_MARKED)
PATTERN = "|".join([_EMAIL, *_MARKED])
#: Stands around entities while a text is cut; a noncharacter of Unicode. Texts that hold it are searched twice instead.
_MARK = "\uffff"


def kind_of(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    return (
        F.when(e.rlike(rf"^{_SECRET}$"), "secret").when(F.contains(e, F.lit("@")), "email").when(e.rlike(rf"^{_IP}$"), "ip").when(e.rlike(rf"^{_SSN}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban").when(e.rlike(r"^\p{L}"), "name").when(e.rlike(r"^[\d -]+$") & (digits >= 13), "card").otherwise("phone")
    )


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^{_TITLE}\.? (?=\p{{Lu}})", 0)


def _gender(e: Column) -> Column:
    return F.when(e.rlike(rf"^(?:{_any(FEMALE_TITLES)}\.?|{_any(FEMALE_NAMES)}) |^{_any(OTHER_TITLES)}\.? {_any(FEMALE_NAMES)} "), "f").when(e.rlike(rf"^(?:{_any(MALE_TITLES)}\.?|{_any(MALE_NAMES)}) |^{_any(OTHER_TITLES)}\.? {_any(MALE_NAMES)} "), "m").otherwise("n")


def atoms(e: Column) -> Column:
    """Array of (kind, value): the last word of a name is a surname, those before are given names."""
    words = F.regexp_extract_all(F.substring(e, F.length(_title(e)) + 1, F.length(e)), F.lit(_WORD), F.lit(0))
    gender = _gender(e)
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.concat(F.lit("surname-"), gender)).otherwise(F.concat(F.lit("given-"), gender)).alias("kind"), w.alias("value")))
    whole = F.array(F.struct(kind_of(e).alias("kind"), e.alias("value")))
    return F.when(kind_of(e) == "name", named).otherwise(whole)


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))


def _like(s: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Every character becomes another of its class; what is no letter or digit stays."""

    def change(c, i):
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", seed, i)).otherwise(c)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", seed, i)).when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), _pick(_CYRILLIC_UP, seed, i)).when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC_LOW, seed, i))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", seed, i)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), change), "")


def _new_name(kind: Column, value: Column, seed: Column, attempt: Column) -> Column:
    def build(syllables, ends):
        listed = F.array(*map(F.lit, syllables))
        # a syllable more every ten attempts: there are always more names than persons
        places = F.sequence(F.lit(0), F.lit(3) + (attempt / 10).cast("int"))
        stem = F.array_join(F.transform(places, lambda i: F.element_at(listed, _draw(seed, i, len(syllables)) + 1)), "")
        return F.initcap(F.concat(stem, ends))

    given = F.startswith(kind, F.lit("given"))
    female, male = F.endswith(kind, F.lit("-f")), F.endswith(kind, F.lit("-m"))
    latin = build(LATIN, F.when(given & female, "na").when(given & male, "n").when(given, "s").otherwise("ck"))
    # a surname's own ending tells its form, as it may stand alone
    cyrillic = build(CYRILLIC, F.when(given & female, "на").when(given, "н").when(F.endswith(value, F.lit("а")), "нова").otherwise("нов"))
    return F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def _mod97(s: Column) -> Column:
    """Of a string of digits and A-Z, a letter standing for two digits."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _new_iban(value: Column, seed: Column) -> Column:
    """Another account of the same country and form; with right check digits if the old ones are right."""
    compact = F.regexp_replace(value, " ", "")
    valid = _mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1
    rest = _like(F.substring(value, F.lit(5), F.length(value)), seed)
    check = F.lit(98) - _mod97(F.concat(F.regexp_replace(rest, " ", ""), F.substring(value, 1, 2), F.lit("00")))
    digits = F.when(valid, F.lpad(check.cast("string"), 2, "0")).otherwise(_like(F.substring(value, 3, 2), F.concat(seed, F.lit("c"))))
    return F.concat(F.substring(value, 1, 2), digits, rest)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of an atom; a later attempt gives another one, names, mail boxes, phones and secrets also longer ones,
    as their own form may leave too few others, or none."""
    # names of either gender are told apart by value alone, so a surname has one stem for a family
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.regexp_replace(kind, "-.$", ""), value, attempt.cast("string")), 256)
    domain = F.substring_index(value, "@", -1)
    domain_seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    more = F.when(attempt >= 10, F.substring(F.translate(seed, "0123456789abcdef", "abcdefghijklmnop"), F.lit(1), (attempt / 10).cast("int"))).otherwise("")
    email = F.concat(_like(F.substring_index(value, "@", 1), seed), more, F.lit("@"), _like(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), domain_seed), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    lead = F.regexp_extract(value, r"^\+\d{1,3}", 0)
    # ten digits of the seed are more than enough: each makes ten times as many
    digits = F.when(attempt >= 10, F.substring(F.translate(seed, "abcdef", "012345"), F.lit(1), (attempt / 10).cast("int"))).otherwise("")
    phone = F.concat(lead, _like(F.substring(value, F.length(lead) + 1, F.length(value)), seed), digits)
    new = F.concat(F.substring(value, 1, 1), _like(F.substring(value, F.lit(2), F.length(value)), seed))
    body = F.substring(new, F.lit(1), F.length(new) - 1)
    checked = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"\D", ""))), 1)
    card = F.when(F.call_function("luhn_check", F.regexp_replace(value, r"\D", "")), checked).otherwise(new)
    before = F.regexp_extract(value, r"^([^=:]*[=:]\s*[\"']?)", 1)
    secret_value = F.substring(value, F.length(before) + 1, F.length(value))
    # one of signs alone has no other of its form
    longer = F.when((attempt > 0) & ~secret_value.rlike("[A-Za-z0-9]"), F.substring(F.translate(seed, "0123456789abcdef", "abcdefghijklmnop"), F.lit(1), F.lit(4) + (attempt / 10).cast("int"))).otherwise(more)
    secret = F.concat(before, F.when(secret_value.rlike("^[0-9a-f]+$"), _like(secret_value, seed, True)).otherwise(_like(secret_value, seed)), longer)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", _like(value, seed)).when(kind == "card", card)
        .when(kind == "secret", secret).when(kind == "iban", _new_iban(value, seed)).otherwise(_new_name(kind, value, seed, attempt))
    )


def _cut(text: Column, pattern: str) -> Column:
    """The text in parts, entities at the odd places; one search, as the marks around what it finds show the cuts."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    twice = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x))))
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(marked)


def cut_at_entities(text: Column) -> Column:
    """The text in parts: what stands between entities, and the entities, in turn; null: null."""
    return F.when(F.contains(text, F.lit("@")), _cut(text, PATTERN)).otherwise(_cut(text, PLAIN))


def with_surnames(parts: Column) -> Column:
    """Parts in which the surnames of the text's entities are entities wherever they stand, but behind an article. Not those
    that are common words: listed ones, and ones that the same text has in lower case."""
    names = F.filter(_entities(parts), lambda e: kind_of(e) == "name")
    surnames = F.array_distinct(F.transform(names, lambda e: F.regexp_extract(e, rf"{_WORD}$", 0)))
    surnames = F.array_except(surnames, F.array(*map(F.lit, COMMON)))
    plain = F.filter(parts, lambda x, i: i % 2 == 0)
    surnames = F.filter(surnames, lambda w: ~F.exists(plain, lambda x: F.contains(x, F.lower(w)) & F.rlike(x, F.concat(F.lit(r"(?<!\p{L})"), F.lower(w), F.lit(r"(?!\p{L})")))))
    pattern = F.concat(F.lit(rf"(?<!\p{{L}})(?<!(?<!\p{{L}})(?i:{'|'.join(BEFORE_NOUNS)})\s)(?:"), F.array_join(surnames, "|"), F.lit(r")(?!\p{L})"))
    again = lambda x: F.split(F.regexp_replace(x, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    wider = F.flatten(F.transform(parts, lambda x, i: F.when((i % 2 == 0) & ~F.contains(x, F.lit(_MARK)), again(x)).otherwise(F.array(x))))
    return F.when(F.size(surnames) > 0, wider).otherwise(parts)


def _entities(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: i % 2 == 1)


def entities(text: Column) -> Column:
    return F.coalesce(_entities(with_surnames(cut_at_entities(text))), F.array().cast("array<string>"))


def retries(found: DataFrame, key: str, most: int = 60) -> DataFrame | None:
    """found (kind, value), distinct atoms: those that need a later attempt, as (kind, value, attempt); None if none."""
    cur = found.withColumn("attempt", F.lit(0))
    for _ in range(most):
        made = cur.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).withColumn("space", F.regexp_replace("kind", "-.$", ""))
        met = made.groupBy("space", "made").agg(F.countDistinct("value").alias("n"), F.min("value").alias("keeps"))
        real = found.select(F.regexp_replace("kind", "-.$", "").alias("space"), F.col("value").alias("made"), F.lit(True).alias("real")).distinct()
        judged = made.join(met.where("n > 1"), ["space", "made"], "left").join(real, ["space", "made"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.coalesce("n", F.lit(1)) > 1) & (F.col("value") != F.col("keeps"))
        nxt = materialize(judged.select("kind", "value", (F.col("attempt") + F.when(again, 1).otherwise(0)).alias("attempt"), again.alias("again")))
        discard(cur)
        if nxt.where("again").isEmpty():
            late = nxt.where("attempt > 0").select("kind", "value", "attempt")
            return None if late.isEmpty() else late
        cur = nxt
    raise RuntimeError("surrogates stay alike")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def secret_key(spark: SparkSession) -> str:
    """The key of the session's setting; the demo key only where all runs on one machine, as in tests."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY_SETTING}: surrogates made with a known key can be undone")
    return key or DEMO_KEY


_drawn: dict[str, str] = {}


def key_of_run(spark: SparkSession) -> str:
    """The key of a query, which takes no arguments: that of secret_key(), but on a cluster without a setting one that is drawn
    for the application, which nobody knows beforehand. All its queries then give the same surrogates, other applications give
    others."""
    if spark.conf.get(KEY_SETTING, None) or spark.sparkContext.master.startswith("local"):
        return secret_key(spark)
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def replace_entities(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with the text's entities replaced, and n_entities long; all other columns stay as they are.

    Null and empty texts stay, with 0 entities; texts of any length are searched whole; repeated rows and copies get the
    same surrogates, in any order of rows; an empty table gives an empty result. A column n_entities of the input is
    replaced. The key is that of the session's setting if none is given;
    without either, a cluster is refused.
    """
    key = key or secret_key(docs.sparkSession)
    parts, row, tries = (_free(docs, x) for x in ("parts", "row", "tries"))
    # searched once: what is written are the parts of the texts in place of the texts
    work = docs.withColumn(parts, cut_at_entities(F.col(text_col))).drop(text_col).withColumn(parts, with_surnames(F.col(parts)))
    work = materialize(work.withColumn(row, F.monotonically_increasing_id()))
    named = F.explode(_entities(F.col(parts)))
    found = materialize(work.where(F.size(parts) > 1).select(named.alias("e")).distinct().select(F.explode(atoms(F.col("e"))).alias("a")).select("a.kind", "a.value").distinct())
    late = retries(found, key)
    if late is None:
        attempt = lambda a: F.lit(0)
    else:  # the rows with such an atom, by their number, which no two rows share
        hit = work.where(F.size(parts) > 1).select(row, named.alias("e")).distinct().select(row, F.explode(atoms(F.col("e"))).alias("a")).select(row, "a.kind", "a.value").distinct()
        of_row = hit.join(late, ["kind", "value"]).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias(tries))
        work = work.join(of_row, row, "left")
        attempt = lambda a: F.coalesce(F.element_at(tries, F.concat_ws("|", a["kind"], a["value"])), F.lit(0))

    def new(e):
        made = F.transform(atoms(e), lambda a: surrogate(a["kind"], a["value"], attempt(a), key))
        # what stands between the words of a name (blank or hyphen) is kept
        gaps = F.regexp_extract_all(F.substring(e, F.length(_title(e)) + 1, F.length(e)), F.lit("[ -]"), F.lit(0))
        name = F.concat(_title(e), F.array_join(F.transform(made, lambda w, i: F.concat(w, F.coalesce(F.get(gaps, i), F.lit("")))), ""))
        return F.when(kind_of(e) == "name", name).otherwise(F.element_at(made, 1))

    p = F.col(parts)
    text = F.when(F.size(p) == 1, F.element_at(p, 1)).otherwise(F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, new(x)).otherwise(x)), ""))
    n = F.when(p.isNull(), 0).otherwise((F.size(p) / 2).cast("long")).cast("long")
    others = [c for c in docs.columns if c != "n_entities"]
    return work.select(*(text.alias(c) if c == text_col else F.col(c) for c in others), n.alias("n_entities"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key_of_run(spark)).select("doc_id", "n_entities", "text")


QUERIES = {"op5_surrogates": op5_surrogates}
ORACLES: dict[str, str] = {}
