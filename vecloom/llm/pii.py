"""Personal data by weak supervision, DataFrame functions only.

Spans are found in Spark SQL: ``regexp_extract_all`` gives the matches of a pattern and ``split`` the
text between them, and running sums over their lengths give the offsets in code points. The
patterns below match what the stated ones match, but each start and repetition is anchored so that
no text makes them backtrack or recurse without bound.

Four kinds are base kinds and always stay. Candidates of further kinds (secret, id, local phone,
person) are accepted by a classifier learned without labels: a regex, a gazetteer and a context
labeler vote on every candidate, base ones too; expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability by kind; and a logistic span classifier is trained on
the posteriors over votes and shape. Counts of patterns, of which there are a fixed number, are all
that reaches the driver, and the classifier comes back as a literal map.

Defined cases: a null or empty text has no spans (the hash is that of nothing); null doc_ids and
repeated rows are rows like others; with no candidates the classifier falls back to a majority of
votes; an empty table gives no rows; further columns are ignored; whole texts are searched.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, pick

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "id", "local", "person")
KINDS = BASE + EXTRA

#: Titles and frequent first names of English, German, French and Spanish.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sir", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Señora", "Señorita", "Sra", "Sr", "Don", "Doña"]
FIRST_NAMES = [
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Christopher", "Nancy", "Daniel", "Lisa",
    "Matthew", "Margaret", "Anthony", "Betty", "Mark", "Sandra", "Donald", "Ashley", "Steven", "Kimberly", "Paul", "Emily", "Andrew", "Donna", "Joshua", "Michelle", "Kenneth", "Carol", "Kevin", "Amanda", "Brian", "Laura", "George", "Emma",
    "Hans", "Peter", "Wolfgang", "Klaus", "Jürgen", "Dieter", "Stefan", "Andreas", "Ursula", "Monika", "Petra", "Sabine", "Renate", "Helga", "Anna", "Julia",
    "Jean", "Pierre", "Michel", "André", "Philippe", "Jacques", "Marie", "Nathalie", "Isabelle", "Catherine", "Sophie", "Camille", "Claire", "Julien", "Nicolas", "Louis",
    "José", "Juan", "Antonio", "Francisco", "Manuel", "Carlos", "Luis", "Miguel", "Javier", "María", "Maria", "Carmen", "Ana", "Isabel", "Dolores", "Pilar", "Lucía", "Elena", "Pablo", "Diego",
]

#: Kind -> Java pattern. Lookbehinds let a match begin only where a run does (or the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "person": r"(?<!\p{L})(?=\p{Lu})(?:" + "|".join(TITLES + FIRST_NAMES) + r")\.?\x20\p{Lu}\p{Ll}++(?![\p{L}])",
}

#: What a text must hold for its pattern to be tried: cheap, and true wherever the pattern matches.
_HINTS = {
    "email": r"@",
    "ip": r"\.[0-9]+\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "secret": r"[0-9A-Za-z_]{20}",
    "id": r"-[0-9][0-9]-",
    "local": r"[0-9]{3}[.-][0-9]{4}",
    "person": PATTERNS["person"],
}

#: Words whose nearness suggests a kind (the gazetteer), lower case, of the same four languages.
_PHONE_WORDS = ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "dial", "telefon", "handy", "anruf", "rufnummer", "téléphone", "appel", "portable", "teléfono", "llame", "móvil", "celular")
GAZETTEER = {
    "email": ("mail", "email", "contact", "write", "reply", "address", "newsletter", "kontakt", "schreib", "adresse", "courriel", "écri", "correo", "contacto", "escrib", "dirección"),
    "ip": ("ip", "host", "server", "address", "addr", "client", "gateway", "subnet", "dns", "router", "proxy", "login", "ping", "adresse", "serveur", "servidor", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "charge", "billing", "invoice", "karte", "kreditkarte", "zahl", "carte", "paiement", "tarjeta", "pago", "crédito"),
    "phone": _PHONE_WORDS,
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "passphrase", "credential", "bearer", "auth", "private", "access", "signature", "passwort", "schlüssel", "geheim", "mot de passe", "clé", "contraseña", "clave"),
    "id": ("ssn", "social", "security", "id", "number", "tax", "passport", "insurance", "ausweis", "steuer", "nummer", "identité", "numéro", "identidad", "número", "pasaporte"),
    "local": _PHONE_WORDS,
    "person": ("name", "contact", "author", "signed", "dear", "sincerely", "regards", "born", "patient", "customer", "liebe", "lieber", "gezeichnet", "autor", "cher", "chère", "auteur", "nom", "querido", "querida", "atentamente", "nombre"),
}
_BLOCK = 256
CONTEXT = 24
SHAPE_BITS = 4


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, though the body uses it often, also in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one, in blocks: n * 256 additions, not n * n."""
    blocks = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    numbers = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(numbers, lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def offsets(parts: Column) -> Column:
        return let(
            F.transform(parts, add),
            lambda sums: F.flatten(F.transform(parts, lambda p, b: let(add(F.slice(sums, F.lit(1), b)), lambda base: F.transform(p, lambda _, i: base + add(F.slice(p, F.lit(1), i)))))),
        )

    return let(cut, offsets)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum over digits from the right, every second one doubled, is a multiple of ten."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return let(_digits(m), _luhn)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "secret":
        return F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]"))
    return F.lit(True)


def _votes(kind: str, m: Column, left: Column, right: Column) -> tuple[Column, Column, Column, Column]:
    """The regex, gazetteer and context labelers' votes (0 or 1), and a shape of SHAPE_BITS bits
    (long, mostly digits, both cases, other characters than letters and digits)."""
    n, digits = F.length(m), F.length(_digits(m))
    strict = {
        "email": F.regexp_like(m, F.lit(r"\.[A-Za-z]{2,24}$")),
        "ip": ~F.regexp_like(m, F.lit(r"(^|\.)0[0-9]")),
        "card": digits == 16,
        "phone": digits.between(10, 13),
        "secret": F.regexp_like(m, F.lit("^([0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{24,})$")),
        "id": ~F.regexp_like(m, F.lit("^(000|666|9)")),
        "local": digits == 10,
        "person": n >= 6,
    }[kind]
    near = F.regexp_like(F.lower(left), F.lit(r"(^|[^a-z])(" + "|".join(GAZETTEER[kind]) + ")"))
    around = F.regexp_like(left, F.lit(r"""[=:"'<(]\x20?["']?$""")) | F.regexp_like(right, F.lit(r"""^["'>)]"""))
    mixed = F.regexp_like(m, F.lit("[a-z]")) & F.regexp_like(m, F.lit("[A-Z]"))
    bits = (n >= 24, digits * 2 >= n, mixed, F.regexp_like(m, F.lit("[^A-Za-z0-9]")))
    shape = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return strict.cast("int"), near.cast("int"), around.cast("int"), shape


def _found(kind: str) -> Column:
    """array<struct<kind, start, end, regex, gazetteer, context, shape>> of one kind in ``text``."""
    pattern = PATTERNS[kind]
    text = F.col("text")

    def spans(v: Column) -> Column:
        matches, pieces = v["matches"], v["pieces"]
        gaps = F.transform(matches, lambda m, i: F.length(F.element_at(pieces, i + 1)) + F.length(m))

        def made(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                left, right = F.element_at(pieces, i + 1), F.element_at(pieces, i + 2)
                start = F.element_at(starts, i + 1) + F.length(left)
                strict, near, around, shape = _votes(kind, m, F.right(left, F.lit(CONTEXT)), F.substring(right, 1, 8))
                return F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), strict.alias("regex"), near.alias("gazetteer"), around.alias("context"), shape.alias("shape"), _valid(kind, m).alias("valid")
                )

            return F.filter(F.transform(matches, one), lambda s: s["valid"])

        return let(_running(gaps), made)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    hint = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(_HINTS[kind]))
    return F.when(hint, let(both, spans))


_SPAN = "array<struct<kind:int,start:int,end:int,regex:int,gazetteer:int,context:int,shape:int,valid:boolean>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), and one array column of spans for each kind."""
    d = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", *[F.coalesce(_found(k), F.array().cast(_SPAN)).cast(_SPAN).alias(k) for k in KINDS])


# ---- the label model and the span classifier: numbers of bounded size, on the driver ----


def reliabilities(counts: dict[tuple[int, int, int, int], int], rounds: int = 50) -> dict[tuple[int, int, int, int], float]:
    """Posterior of each (kind, vote, vote, vote): EM for labelers independent given the truth, with
    a share of true spans and each labeler's hit and false-alarm rates for each kind (smoothed)."""
    post: dict[tuple[int, int, int, int], float] = {}
    for kind in range(len(KINDS)):
        own = {k: c for k, c in counts.items() if k[0] == kind}
        n, prior, hit, false = sum(own.values()), 0.5, [0.8] * 3, [0.2] * 3
        for _ in range(rounds if own else 0):
            for key in own:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(key[1:]):
                    a += math.log(hit[j] if v else 1 - hit[j])
                    b += math.log(false[j] if v else 1 - false[j])
                post[key] = 1 / (1 + math.exp(max(-700, min(700, b - a))))
            true = sum(c * post[k] for k, c in own.items())
            prior = (true + 2) / (n + 4)
            for j in range(3):
                yes = sum(c * post[k] * k[1 + j] for k, c in own.items())
                wrong = sum(c * (1 - post[k]) * k[1 + j] for k, c in own.items())
                # a labeler is held to be better than chance, else truth and falsehood may change places
                hit[j] = max(0.51, (yes + 4) / (true + 5))
                false[j] = min(0.49, (wrong + 1) / (n - true + 5))
    return post


def _inputs(votes: tuple[int, int, int], shape: int) -> list[float]:
    return [1.0, *map(float, votes), *(float(shape >> i & 1) for i in range(SHAPE_BITS))]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def classifier(patterns: dict[tuple[int, int, int, int, int], int], rounds: int = 400) -> dict[tuple[int, int, int, int, int], float]:
    """Score of every possible (kind, votes, shape): for each kind a logistic regression on the posteriors of
    the vote patterns found, weighted by count, over votes and shape."""
    counts: dict[tuple[int, int, int, int], int] = {}
    for key, n in patterns.items():
        counts[key[:4]] = counts.get(key[:4], 0) + n
    post = reliabilities(counts)
    start = [-1.0, 1.0, 1.0, 1.0, *([0.0] * SHAPE_BITS)]  # a majority of votes, where nothing is learned
    out = {}
    for kind in range(len(KINDS)):
        rows = [(_inputs(k[1:4], k[4]), post[k[:4]], n) for k, n in sorted(patterns.items()) if k[0] == kind]
        total = sum(n for *_, n in rows)
        w = list(start)
        for _ in range(rounds if total else 0):
            grad = [1e-3 * (a - b) for a, b in zip(w, start, strict=True)]
            for x, y, n in rows:
                p = _sigmoid(sum(a * b for a, b in zip(w, x, strict=True)))
                for i, xi in enumerate(x):
                    grad[i] += n / total * (p - y) * xi
            w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
        for v in product((0, 1), repeat=3):
            for shape in range(1 << SHAPE_BITS):
                out[(kind, *v, shape)] = _sigmoid(sum(a * b for a, b in zip(w, _inputs(v, shape), strict=True)))
    return out


def learn(found: DataFrame) -> dict[tuple[int, int, int, int, int], float]:
    """The classifier for a table of ``candidates``: at most 8 * len(KINDS) * 2**SHAPE_BITS counts are collected."""
    span = F.explode(F.concat(*KINDS)).alias("s")
    rows = found.select(span).groupBy("s.kind", "s.regex", "s.gazetteer", "s.context", "s.shape").count().collect()
    return classifier({tuple(r)[:5]: r["count"] for r in rows})


def accepted(found: DataFrame, scores: dict[tuple[int, int, int, int, int], float], least: float = 0.5) -> DataFrame:
    """Adds ``more``: the extra kinds' spans that the classifier accepts and no base span overlaps,
    by kind, then start."""
    code = lambda s: (((s["kind"] * 2 + s["regex"]) * 2 + s["gazetteer"]) * 2 + s["context"]) * 2**SHAPE_BITS + s["shape"]
    good = [(((k * 2 + a) * 2 + b) * 2 + c) * 2**SHAPE_BITS + s for (k, a, b, c, s), p in scores.items() if p >= least and KINDS[k] in EXTRA]
    base = F.concat(*BASE)
    picked = F.filter(F.concat(*EXTRA), lambda s: code(s).isin(good) if good else F.lit(False))
    free = F.when(F.size(picked) > 0, let(base, lambda b: F.filter(picked, lambda s: ~F.exists(b, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))))
    return found.withColumn("more", F.coalesce(free, F.array().cast(_SPAN)))


def listed(spans: Column) -> Column:
    """kind:start:end of spans that are in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of each kind, and ``more``; reads each text once."""
    found = Table(candidates(docs), "pii").df
    return accepted(found, learn(found))


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_found (spans of all kinds)."""
    base = F.concat(*BASE)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(base, "more")).alias("spans"),
        F.size("more").cast("long").alias("n_more"),
        F.size(F.concat(base, "more")).cast("long").alias("n_found"),
    )


def _merged(spans: Column) -> Column:
    """Spans in order of start, those that overlap an earlier one joined to it."""
    kept = "array<struct<start:int,end:int,kind:int>>"
    flat = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(flat, F.array().cast(kept), add)


def redact(docs: DataFrame, length: str | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; other columns, and texts without a
    span, stay as they are. ``length`` names a column that gets the new text's length in code points (0 for null).

    Columns are taken by position: an exact name, else one that differs by case only, so further columns that clash
    are kept and never read for the wanted ones.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    at = lambda n: plain[names.index(n) if n in names else [x.lower() for x in names].index(n)]
    where = at("text")
    rows = docs.toDF(*plain).withColumn("text", F.coalesce(F.col(where).cast("string"), F.lit("")))
    kept = Table(rows.select(*plain, *[F.coalesce(_found(k), F.array().cast(_SPAN)).cast(_SPAN).alias(k) for k in KINDS]), "pii").df
    found = accepted(kept, learn(kept.select(*KINDS)))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(where)

    def rebuilt(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        piece = lambda s, i: F.concat(F.substring(text, F.element_at(starts, i + 1) + 1, s["start"] - F.element_at(starts, i + 1)), F.element_at(tags, s["kind"] + 1))
        tail = F.substring(text, F.element_at(starts, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

    every = F.concat(*BASE, "more")
    changed = F.when(F.size(every) > 0, let(_merged(every), rebuilt)).otherwise(text)
    out = found.withColumn(where, changed)
    if length is not None:
        out = out.withColumn(at(length), F.coalesce(F.length(where), F.lit(0)).cast(docs.schema[plain.index(at(length))].dataType))
    return out.select(*plain).toDF(*names)
