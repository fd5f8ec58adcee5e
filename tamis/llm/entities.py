"""Spellings of one person or organisation, linked.

A name is read into tokens: the root (the longest of its surnames or trade names), the facet (given name or sector) and the
other rare tokens, with titles, particles, initials and legal forms set apart. Names are candidates of each other by the
similarity of the q-gram sets of their rare tokens: of each only the rarest q-grams are joined, as many as the allowed edits
can spoil and one more, so no similar pair is missed. Candidates are verified by a soft weighted similarity of all their
tokens, in which rare tokens count more, and two names that each have a rare token the other lacks are never one; each name then
follows the best supported one it resembles. Names that lack a token join the one entity that they allow, and none where there
are several.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.llm.groups import consolidate
from tamis.llm.lists import Trie, shortens
from tamis.llm.names import fold, letters
from tamis.session import durable, spread

PERSON, COMPANY = "personne", "employeur"
#: Least share of all rows that a given name of the lexicon has, which so holds 1 / GIVEN_SHARE names at most. Rarer ones are
#: compared as they are written, like any other token.
GIVEN_SHARE = 1e-4
#: Length of the q-grams, and how many of them are counted, the most frequent; others rank before these, the same for all names.
Q, COUNTED_GRAMS = 3, 50_000
#: Least weighted similarity of two names, and how many spellings make a root a name in its own right.
LEAST, ESTABLISHED = 0.75, 4

#: Titles, particles and nicknames of persons.
TITLES = frozenset("mr mme mlle monsieur madame mademoiselle mrs ms dr pr sr".split())
PARTICLES = ("ould", "ait", "ben", "bel", "el", "al", "bou", "bent", "ibn", "de", "la", "le")
FUSED = ("ould", "ait", "ben", "bel", "el", "al")
NICKNAMES = {
    "hakim": "abdelhakim", "yass": "yassine yasmine", "zinouba": "zineb", "rahim": "abderrahim", "khadouj": "khadija", "zak": "zakaria", "moss": "mustapha", "mimi": "meryem", "abdou": "abdellatif abderrahim abdelhakim",
    "med": "mohamed", "latif": "abdellatif", "simo": "mohamed", "rach": "rachid", "fatiza": "fatima zahra", "fati": "fatima zahra", "houssa": "houssine", "aziz": "abdelaziz", "kader": "abdelkader",
}
#: Legal forms, kinds of companies and sectors.
LEGAL = frozenset("sarl sarlau sa sas sasu snc eurl gie scop".split())
KINDS = {"groupe": "groupe gpe grp", "societe": "societe ste soc", "compagnie": "compagnie comp cie", "etablissements": "etablissements etablissement ets etab"}
SECTORS = tuple(
    s.split()
    for s in (
        "energie", "cablage", "transit douane", "negoce", "pharma", "pieces auto", "securite privee", "import export", "imprimerie", "logistique", "hotellerie", "electronique", "materiaux", "industrie", "agroalimentaire", "travaux publics", "confection",
        "transport", "construction", "conseil", "services", "plasturgie", "textile", "emballage", "distribution", "agricole", "immobilier", "informatique", "mecanique", "metallurgie", "menuiserie", "nettoyage", "restauration", "tourisme", "assurance", "chimie", "peche",
    )
)
SECTOR_FORMS = {"hotels": "hotellerie", "hotel": "hotellerie", "imp": "import imprimerie", "exp": "export", "tp": "travaux publics", "agro": "agroalimentaire", "alim": "agroalimentaire", "cons": "construction conseil", "mat": "materiaux", "svces": "services"}


def edits_for(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else 2


class People:
    """Reads names of persons; lexicon: given names of one or more words, the corpus's own."""

    def __init__(self, lexicon: tuple[str, ...]):
        self.trie = Trie()
        self.of_word: dict[str, set[str]] = {}
        for given in lexicon:
            for w in {*given.split(), given.replace(" ", "")}:
                self.of_word.setdefault(w, set()).add(given)
        for w in self.of_word:
            self.trie.add(w, w)
        self.seen: dict[str, tuple[int, frozenset[str]]] = {}

    def given(self, token: str) -> tuple[int, frozenset[str]]:
        """(edits, given names) that a token may be; (9, nothing) if none."""
        if token not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[token] = self._given(token)
        return self.seen[token]

    def _given(self, token: str) -> tuple[int, frozenset[str]]:
        if token in self.of_word:
            return 0, frozenset(self.of_word[token])
        if token in NICKNAMES:
            known = {g for w in NICKNAMES[token].split() for g in self.of_word.get(w, ())}
            if known:
                return 0, frozenset(known)
        if near := self.trie.search(token, 1 if len(token) < 6 else 2):
            least = min(near.values())
            return least, frozenset(g for w, e in near.items() if e == least for g in self.of_word[w])
        if len(token) == 5 and (near := {w for w in self.trie.search(token, 2) if w[0] == token[0]}):
            return 2, frozenset(g for w in near for g in self.of_word[w])
        short = {g for w, gs in self.of_word.items() if len(token) > 2 and (w.startswith(token) or shortens(token, w) >= 1) for g in gs}
        return (3, frozenset(short)) if short else (9, frozenset())

    def read(self, text: str) -> tuple[str, list[str], str, str, str, str]:
        """(root, given names it may have, initial, '', particle, other rare tokens in order)."""
        found = re.findall(r"[^\W_]+", fold(text))
        initials, long, particle = [], [], ""
        for k, t in enumerate(found):
            t = letters(t)
            if t in PARTICLES:
                particle = particle or ("el" if t == "al" else t)
                continue
            if t in TITLES or (t == "m" and k == 0):
                continue
            if len(t) == 1:
                initials.append(t)
            else:
                long.append(t)
        fused = [next((p for p in FUSED if t.startswith(p) and len(t) - len(p) > 4), "") if self.given(t)[0] else "" for t in long]
        plain = [t[len(p) :] for t, p in zip(long, fused)]
        if not plain:
            return "", [], "", "", "", ""
        near = [self.given(t) for t in plain]
        others = [k for k in range(len(plain)) if near[k][0] > edits_for(len(plain[k]))] or [k for k in range(len(plain)) if near[k][0]]
        if not others:
            return "", [], "", "", "", ""
        at = max(others, key=lambda k: (len(plain[k]), -k))
        covered: dict[str, set[str]] = {}
        for k, (edits, names) in enumerate(near):
            if k != at and edits < 9:
                for g in names:
                    covered.setdefault(g, set()).add(plain[k])
        unknown = [plain[k] for k in range(len(plain)) if k != at and near[k][0] == 9]
        full = {g: len(c) for g, c in covered.items() if len(c) >= len(g.split()) or any(self.given(t)[0] <= 2 and g.replace(" ", "")[:4] == t[:4] and len(t) > 8 for t in c)}
        pool = full or {g: len(c) for g, c in covered.items()}
        most = max(pool.values(), default=0)
        givens = sorted(g for g, n in pool.items() if n == most)
        if not givens and unknown:
            givens, unknown = [" ".join(unknown)], []
        particle = particle or ("el" if fused[at] == "al" else fused[at])
        return plain[at], givens, "" if givens or not initials else initials[0], "", particle, " ".join(sorted(set(unknown)))


class Companies:
    """Reads names of organisations."""

    def __init__(self, lexicon: tuple[str, ...] = ()):
        self.words, self.kinds = Trie(), Trie()
        self.sector_of: dict[str, list[str]] = {}
        self.initials: dict[str, str] = {}
        for s in SECTORS:
            for w in s:
                self.sector_of.setdefault(w, []).append(" ".join(s))
                for form in (w, w + "s"):
                    self.words.add(form, w)
            if len(s) > 1:
                self.initials["".join(w[0] for w in s)] = " ".join(s)
        for kind, forms in KINDS.items():
            for form in forms.split():
                self.kinds.add(form, kind)
        self.seen: dict[str, tuple[str, frozenset[str]]] = {}

    def sort(self, token: str) -> tuple[str, frozenset[str]]:
        """('legal' | 'kind' | 'sector' | 'root', what it may be)."""
        if token not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[token] = self._sort(token)
        return self.seen[token]

    def _sort(self, token: str) -> tuple[str, frozenset[str]]:
        if token in LEGAL:
            return "legal", frozenset([token])
        if kind := self.kinds.search(token, 0 if len(token) < 6 else 1):
            return "kind", frozenset(kind)
        if token in self.initials:
            return "sector", frozenset([self.initials[token]])
        if token in SECTOR_FORMS:
            whole = SECTOR_FORMS[token]
            return "sector", frozenset([whole]) if whole in self.initials.values() else frozenset(s for w in whole.split() for s in self.sector_of[w])
        begun = frozenset(s for w, own in self.sector_of.items() if len(token) > 2 and w.startswith(token) for s in own)
        if begun:
            return "sector", begun
        if near := self.words.search(token, edits_for(len(token))):
            least = min(near.values())
            return "sector", frozenset(s for w, e in near.items() if e == least for s in self.sector_of[w])
        if len(token) < 8:
            likely = {w: shortens(token, w) for w in self.sector_of if len(token) > 1}
            best = max(likely.values(), default=0)
            if best >= 0.8:
                return "sector", frozenset(s for w, x in likely.items() if x == best for s in self.sector_of[w])
        return "root", frozenset()

    def read(self, text: str) -> tuple[str, list[str], str, str, str, str]:
        """(root, sectors it may have, '', legal form, kind of company, other rare tokens in order)."""
        found = []
        for chunk in re.split(r"[\s/&,;()-]+", fold(text)):
            if re.fullmatch(r"(?:[a-z]\.){1,6}[a-z]?\.?", chunk):
                found.append(chunk.replace(".", ""))
            else:
                found += [letters(t) for t in re.findall(r"[^\W_]+", chunk)]
        for k in range(len(found) - 1):
            if found[k : k + 2] == ["sarl", "au"]:
                found[k : k + 2] = ["sarlau", ""]
        legal, kind, roots = "", "", []
        sectors: dict[str, int] = {}
        for t in found:
            if not t or t in ("et", "de", "la", "au", "le", "du", "des"):
                continue
            what, options = self.sort(t)
            if what == "legal":
                legal = t
            elif what == "kind":
                kind = min(options)
            elif what == "sector":
                for s in options:
                    sectors[s] = sectors.get(s, 0) + 1
            elif len(t) > 2:
                roots.append(t)
        most = max(sectors.values(), default=0)
        root = max(roots, key=len, default="")
        return root, sorted(s for s, n in sectors.items() if n == most), "", legal, kind, " ".join(sorted(set(roots) - {root}))


@lru_cache(maxsize=2)
def _readers(lexicon: tuple[str, ...]) -> dict[str, object]:
    return {PERSON: People(lexicon), COMPANY: Companies()}


_READ = "famille STRING, value STRING, root STRING, facets ARRAY<STRING>, initial STRING, legal STRING, kind STRING, others STRING"


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = _readers(shared.value)
        for batch in batches:
            rows = [readers[f].read(v) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.string()) if i == 1 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["famille", "value", "root", "facets", "initial", "legal", "kind", "others"])

    return run


def grams(root: str) -> list[str]:
    padded = f"^{root}$"
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)] or [padded]


def _prefix(shared):
    """The rarest q-grams of each root with their places: Q * edits + 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            rows, found, places = [], [], []
            for k, root in enumerate(batch.column("root").to_pylist()):
                own = sorted(enumerate(grams(root)), key=lambda x: (frequency.get(x[1], 0), x))
                for at, g in own[: Q * edits_for(len(root)) + 1]:
                    rows.append(k)
                    found.append(g)
                    places.append(at)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(found, pa.string()), pa.array(places, pa.int32())], [*batch.schema.names, "gram", "at"])

    return run


def _edits(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 4, 0).when(n < 6, 1).otherwise(2)


def similar_roots(followers: DataFrame, leaders: DataFrame, on: list[str]) -> DataFrame:
    """(on..., root, lead, edits, swapped, n, lead_n): roots within the allowed edits of each other, by the prefix filter.

    The frequencies of COUNTED_GRAMS q-grams are broadcast. They only say in which order all roots take their q-grams.
    """
    spark = leaders.sparkSession
    padded = F.concat(F.lit("^"), "root", F.lit("$"))
    counted = leaders.select("root").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - Q + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(Q)))).alias("g"))
    shared = spark.sparkContext.broadcast({r.g: r.n for r in counted.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(COUNTED_GRAMS).collect()})
    keep = [*on, "root", "n", "particle"]
    schema = ", ".join([*(f"{c} STRING" for c in on), "root STRING, n BIGINT, particle STRING, gram STRING, at INT"])
    a = leaders.select(*keep).mapInArrow(_prefix(shared), schema).withColumnsRenamed({"root": "lead", "n": "lead_n", "particle": "lead_particle", "at": "lead_at"})
    b = followers.select(*keep).mapInArrow(_prefix(shared), schema)
    # a shared q-gram lies at most as many places apart as there are edits
    apart = F.abs(F.col("at") - F.col("lead_at")) <= 2
    near = a.join(b, [*on, "gram"]).filter(apart & (F.abs(F.length("root") - F.length("lead")) <= 2) & (F.col("root") != F.col("lead")))
    edits = F.levenshtein("root", "lead", 2)
    near = near.withColumn("edits", edits).filter((F.col("edits") >= 0) & (F.col("edits") <= F.least(_edits(F.col("root")), _edits(F.col("lead")))))
    letters_of = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.col("edits") == 2) & (letters_of("root") == letters_of("lead"))
    # another particle is another name; a missing one is believed with one edit
    same, missing = F.col("particle") == F.col("lead_particle"), (F.col("particle") == "") | (F.col("lead_particle") == "")
    near = near.filter(same | (missing & ((F.col("edits") < 2) | swapped)))
    return near.select(*on, "root", "lead", "edits", swapped.alias("swapped"), "n", "lead_n").distinct()


def _lexicon(givens: DataFrame, given: str, share: float) -> tuple[str, ...]:
    """The given names that make up at least a share of all rows, as typed, in lower case."""
    counted = givens.filter(F.col(given).rlike(r"\p{L}{2}")).groupBy(F.lower(F.col(given)).alias("g")).count()
    total = counted.agg(F.sum("count").alias("total"))  # one row
    kept = counted.join(F.broadcast(total)).filter(F.col("count") >= F.col("total") * share).select("g").collect()
    return tuple(sorted({" ".join(re.findall(r"[^\W\d_]+", fold(r.g))) for r in kept} - {""}))


def link_names(names: DataFrame, givens: DataFrame, famille: str = "famille", value: str = "valeur", given: str = "valeur", given_share: float = GIVEN_SHARE) -> DataFrame:
    """(famille, value, entity_id): every different non-blank name with an identifier of its person or organisation.

    famille is 'personne' or 'employeur'; other families and blank or null names give no row, repeated rows count once. givens
    holds given names, as typed; those with at least given_share of its rows are used, and none need be. A name without a rare
    part, or one that several relatives or sister companies could own, is an entity of its own. Extra columns are ignored.
    """
    spark = names.sparkSession
    rows = names.select(F.col(famille).alias("famille"), F.col(value).cast("string").alias("value"))
    rows = rows.filter(F.col("famille").isin(PERSON, COMPANY) & F.col("value").rlike(r"[^\s\p{Z}]")).distinct()
    shared = spark.sparkContext.broadcast(_lexicon(givens, given, given_share))
    read = durable(spread(rows, "value").mapInArrow(_read(shared), _READ))

    # entities: full names, each following the best supported one that it resembles under the same facet and other tokens
    full = F.size("facets") == 1
    key = ["famille", "facet", "others", "root"]
    particle = F.when(F.col("famille") == PERSON, F.mode("kind", True)).otherwise("").alias("particle")
    whole = read.filter(full & (F.col("root") != "")).withColumn("facet", F.element_at("facets", 1))
    units = durable(whole.groupBy(*key).agg(F.count("*").alias("n"), particle, F.count_distinct(_words_of("value")).alias("m")))
    total = max(units.count(), 2)
    follows = _followers(units, total)
    vertex = lambda root, others="others": F.concat_ws("|", "famille", "facet", others, root)
    edges = follows.select(vertex("root").alias("a"), vertex("lead").alias("b"))
    extra = units.filter("others <> ''")
    with_others = not extra.isEmpty()
    if with_others:  # the other tokens of one root may be misread as well
        extra = extra.select("famille", F.concat_ws("|", "facet", "root").alias("of"), F.col("others").alias("root"), "n", "particle")
        similar = similar_roots(extra, extra, ["famille", "of"]).filter("lead < root")
        named = similar.withColumns({"facet": F.substring_index("of", "|", 1), "name": F.substring_index("of", "|", -1)})
        edges = edges.unionByName(named.select(vertex("name", "root").alias("a"), vertex("name", "lead").alias("b")))
    classes = consolidate(edges)
    entities = durable(units.withColumn("v", vertex("root")).join(classes, "v", "left").select(*key, "n", "particle", F.coalesce("r", "v").alias("entity")))
    entities = _completed(entities) if with_others else entities
    done = whole.join(entities, key).select("famille", "value", "entity", "legal", "kind")
    used = lambda c: F.mode(F.when(F.col(c) != "", F.col(c)), True).alias(f"own_{c}")
    owned = durable(entities.join(done.groupBy("entity").agg(used("legal"), used("kind")), "entity"))

    # the rest: the only entity of the same root, else of the most similar one, that they allow
    rest = read.filter(~full & (F.col("root") != ""))
    roots = owned.groupBy("famille", "root").agg(F.sum("n").alias("n"), F.mode("particle", True).alias("particle"))
    strange = rest.groupBy("famille", "root").agg(F.count("*").alias("n"), particle).join(roots.select("famille", "root"), ["famille", "root"], "left_anti")
    best = similar_roots(strange, roots, ["famille"]).groupBy("famille", "root").agg(F.max_by("lead", F.struct(-F.col("edits"), "lead_n", "lead")).alias("lead"))
    rest = rest.join(best, ["famille", "root"], "left").withColumn("lead", F.coalesce("lead", "root"))
    # what names allow depends on few of their traits, so those with the same traits count as one
    traits = ["famille", "lead", "facets", "initial", "legal", "others"]
    asked = rest.select(*traits).distinct().withColumn("ask", F.xxhash64(*traits))
    entity_of = owned.select("famille", F.col("root").alias("lead"), "facet", F.col("others").alias("own_others"), "entity", "own_legal").distinct()
    allowed = asked.join(entity_of, ["famille", "lead"]).filter(_allowed()).groupBy("famille", "lead", "ask").agg(F.min("entity").alias("first"), F.max("entity").alias("last"))
    known = roots.select("famille", F.col("root").alias("lead"), F.lit(True).alias("known"))
    placed = rest.withColumn("ask", F.xxhash64(*traits)).join(allowed, ["famille", "lead", "ask"], "left").join(known, ["famille", "lead"], "left")
    # names of a root without any full name are one where they have the same other tokens and no two legal forms
    same = ["famille", "facets", "others", "root", "initial"]
    forms = rest.groupBy(*same).agg(F.count_distinct(F.nullif("legal", F.lit(""))).alias("forms"))
    placed = placed.join(forms, same, "left")
    form = F.when(F.col("forms") > 1, F.col("legal")).otherwise("")
    alone = F.concat_ws("|", "famille", F.concat_ws(",", "facets"), "others", "root", F.concat_ws("~", F.lit("?"), "initial", form))
    own = F.when(F.col("known"), F.concat_ws("|", F.lit("?"), "famille", "value")).otherwise(alone)
    partial = placed.select("famille", "value", F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(own).alias("entity_id"))
    rootless = read.filter(F.col("root") == "").select("famille", "value", F.concat_ws("|", F.lit("?"), "famille", "value").alias("entity_id"))
    return done.select("famille", "value", F.col("entity").alias("entity_id")).unionByName(partial).unionByName(rootless)


def _followers(units: DataFrame, total: int) -> DataFrame:
    """(famille, facet, others, root, lead): names that are taken for misread ones, and the best supported name that each resembles.

    The likeness is the weight of the tokens of both, each token weighing by its rarity and by the share of its letters that are
    the same; the facet and the other tokens are the same.
    """
    on = ["famille", "facet", "others"]
    common = units.groupBy("famille", "facet").agg(F.sum("n").alias("facet_n"))
    near = similar_roots(units, units, on).filter((F.col("lead_n") > F.col("n")) | ((F.col("lead_n") == F.col("n")) & (F.col("lead") < F.col("root"))))
    # two edits other than a swap are believed of a root with one set of words, or with few beside those of its lead
    sets = units.select(*on, "root", "m")
    near = near.join(sets, [*on, "root"]).join(sets.withColumnsRenamed({"root": "lead", "m": "lead_m"}), [*on, "lead"])
    few = (F.col("n") == 1) | (F.col("m") == 1) | (F.col("m") * 3 <= F.col("lead_m"))
    near = near.filter(((F.col("n") < ESTABLISHED) | (F.col("n") * 3 <= F.col("lead_n"))) & ((F.col("edits") < 2) | F.col("swapped") | few))
    weight = lambda n: F.log(1 + F.lit(float(total)) / n)
    rare, rest = weight(F.col("n")), weight(F.col("facet_n"))
    likeness = (rare * (1 - F.col("edits") / F.greatest(F.length("root"), F.length("lead"))) + rest) / (rare + rest)
    near = near.join(common, ["famille", "facet"]).withColumn("likeness", likeness).filter(F.col("likeness") >= LEAST)
    return near.groupBy(*on, "root").agg(F.max_by("lead", F.struct(-F.col("edits"), "lead_n", "likeness", "lead")).alias("lead"))


def _completed(entities: DataFrame) -> DataFrame:
    """entities where a name without other tokens belongs to the only entity with some that has its facet and root, if there is one."""
    pair = ["famille", "facet", "root"]
    fuller = entities.filter("others <> ''").groupBy(*pair).agg(F.min("entity").alias("first"), F.max("entity").alias("last"))
    bare = entities.filter("others = ''").join(fuller, pair).groupBy("entity").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first = last")
    joined = entities.join(bare.select("entity", "first"), "entity", "left")
    return durable(joined.select(*pair, "others", "n", "particle", F.coalesce("first", "entity").alias("entity")))


def _words_of(c: str) -> Column:
    """The different words of a name in order, without titles: the same for spellings that differ in case, order and title only."""
    return F.array_sort(F.array_except(T.words(T.lower_words(F.col(c))), F.lit(sorted(TITLES))))


def _allowed() -> Column:
    """Does a name allow an entity: a given name among its own, or its initial; no other legal form, and no other rare token."""
    words = F.split("facet", " ")
    facet = F.when(F.size("facets") > 0, F.array_contains("facets", F.col("facet"))).when(F.col("initial") != "", F.exists(words, lambda w: F.startswith(w, F.col("initial")))).otherwise(True)
    legal = (F.col("legal") == "") | F.col("own_legal").isNull() | (F.col("legal") == F.col("own_legal"))
    others = (F.col("others") == "") | (F.col("own_others") == "") | (F.col("others") == F.col("own_others"))
    return facet & legal & others
