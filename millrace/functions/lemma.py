"""Lemmas: irregular forms by lexicon, everything else by the stemmer.

The lexicon is made of paradigms, as grammars of English list them: a lemma with its irregular forms. Regular forms of irregular verbs (-s, -ing) and
compounds with verb prefixes follow by rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stem import stem_words
from .strings import to_lower

# lemma: irregular forms
VERBS = """
be: am is are was were been being; have: has had having; do: does did done doing; go: goes went gone going
say: said; make: made; get: got gotten; know: knew known; take: took taken; see: saw seen; come: came; think: thought
give: gave given; find: found; tell: told; become: became; leave: left; feel: felt; put: put; bring: brought
begin: began begun; keep: kept; hold: held; write: wrote written; stand: stood; hear: heard; let: let; mean: meant
set: set; meet: met; run: ran; pay: paid; sit: sat; speak: spoke spoken; lie: lay lain lying; lead: led; read: read
grow: grew grown; lose: lost; fall: fell fallen; send: sent; build: built; understand: understood; draw: drew drawn
break: broke broken; spend: spent; cut: cut; rise: rose risen; drive: drove driven; buy: bought; wear: wore worn
choose: chose chosen; seek: sought; throw: threw thrown; catch: caught; deal: dealt; win: won; forget: forgot forgotten
eat: ate eaten; fly: flew flown; teach: taught; sing: sang sung; swim: swam swum; ring: rang rung; drink: drank drunk
sleep: slept; sell: sold; fight: fought; hide: hid hidden; ride: rode ridden; bite: bit bitten; shake: shook shaken
steal: stole stolen; freeze: froze frozen; tear: tore torn; swear: swore sworn; bear: bore borne; blow: blew blown
bind: bound; wind: wound; grind: ground; dig: dug; stick: stuck; strike: struck stricken; swing: swung; hang: hung
cling: clung; fling: flung; sink: sank sunk; shrink: shrank shrunk; spring: sprang sprung; stink: stank stunk
wake: woke woken; weave: wove woven; forgive: forgave forgiven; sweep: swept; weep: wept; creep: crept; bend: bent
lend: lent; shoot: shot; slide: slid; shine: shone; feed: fed; breed: bred; flee: fled; lay: laid; light: lit
arise: arose arisen; awake: awoke awoken; beat: beaten; bid: bade bidden; forbid: forbade forbidden; forsake: forsook forsaken
bleed: bled; spin: spun; sling: slung; slink: slunk; string: strung; wring: wrung; win: won; spit: spat; sting: stung
strive: strove striven; thrive: throve thriven; swell: swollen; shear: shorn; sew: sewn; sow: sown; saw: sawn; mow: mown
show: shown; prove: proven; strew: strewn; hew: hewn; lade: laden; tread: trod trodden; slay: slew slain; smite: smote smitten
speed: sped; spill: spilt; spoil: spoilt; spell: spelt; smell: smelt; learn: learnt; burn: burnt; dream: dreamt; lean: leant
leap: leapt; kneel: knelt; dwell: dwelt; cleave: clove cloven; behold: beheld; beget: begot begotten; abide: abode
hit: hit; cast: cast; cost: cost; hurt: hurt; burst: burst; bet: bet; quit: quit; rid: rid; shed: shed; shut: shut; slit: slit
split: split; spread: spread; thrust: thrust; upset: upset; wed: wed; knit: knit; beset: beset; sweat: sweat; broadcast: broadcast
forecast: forecast; befall: befell befallen; bespeak: bespoke bespoken; chide: chid chidden; clothe: clad; stride: strode stridden
"""
NOUNS = """
child: children; man: men; woman: women; person: people; foot: feet; tooth: teeth; goose: geese; mouse: mice
louse: lice; ox: oxen; datum: data; criterion: criteria; phenomenon: phenomena; bacterium: bacteria
curriculum: curricula; medium: media; analysis: analyses; hypothesis: hypotheses; thesis: theses
parenthesis: parentheses; crisis: crises; basis: bases; axis: axes; index: indices; matrix: matrices
cactus: cacti; fungus: fungi; nucleus: nuclei; stimulus: stimuli; radius: radii; alumnus: alumni; focus: foci; locus: loci
syllabus: syllabi; terminus: termini; bacillus: bacilli; hippopotamus: hippopotami; octopus: octopi; corpus: corpora; genus: genera
appendix: appendices; vertex: vertices; vortex: vortices; codex: codices; apex: apices; memorandum: memoranda; stratum: strata
erratum: errata; addendum: addenda; symposium: symposia; aquarium: aquaria; stadium: stadia; millennium: millennia; spectrum: spectra
referendum: referenda; ovum: ova; forum: fora; formula: formulae; alga: algae; larva: larvae; vertebra: vertebrae; nebula: nebulae
antenna: antennae; alumna: alumnae; emphasis: emphases; synthesis: syntheses; diagnosis: diagnoses; oasis: oases; neurosis: neuroses
synopsis: synopses; ellipsis: ellipses; automaton: automata; schema: schemata; stigma: stigmata; die: dice; penny: pence
calf: calves; elf: elves; self: selves; scarf: scarves; hoof: hooves; sheaf: sheaves; dwarf: dwarves; wharf: wharves
hero: heroes; potato: potatoes; tomato: tomatoes; echo: echoes; veto: vetoes; torpedo: torpedoes; grandchild: grandchildren
policeman: policemen; policewoman: policewomen; fireman: firemen; salesman: salesmen; gentleman: gentlemen; fisherman: fishermen
chairman: chairmen; sheep: sheep; deer: deer; fish: fish; series: series; species: species; means: means; aircraft: aircraft
spacecraft: spacecraft; offspring: offspring; salmon: salmon; trout: trout; moose: moose; bison: bison; swine: swine; shrimp: shrimp
life: lives; knife: knives; wife: wives; wolf: wolves; half: halves; shelf: shelves; thief: thieves; loaf: loaves
"""
#: Entries of a lexicon that is broadcast: some megabytes.
FEW = 100_000
#: Loaded last: bad and good win over the adverbs badly and well.
ADJECTIVES = "bad: worse worst; good: better best; far: farther farthest further furthest; little: less least; much: more most"
PREFIXES = {"under": "take go stand", "over": "take come throw run hang see", "with": "draw hold stand", "fore": "see tell", "mis": "take lead understand", "re": "write build make think take"}
DOUBLED = set("get let set put run sit cut win swim dig forget begin hit bet bid forbid quit rid shed shut slit split spit spin upset wed knit beset beget".split())


def _paradigms(text: str) -> Iterable[tuple[str, list[str]]]:
    for part in text.replace("\n", ";").split(";"):
        if part.strip():
            lemma, forms = part.split(":")
            yield lemma.strip(), forms.split()


def _regular(verb: str) -> list[str]:
    """The -s and -ing forms of a verb."""
    s = verb + ("es" if verb.endswith(("s", "sh", "ch", "x", "z", "o")) else "s")
    if verb.endswith("y") and verb[-2] not in "aeiou":
        s = verb[:-1] + "ies"
    if verb in DOUBLED:
        ing = verb + verb[-1] + "ing"
    elif verb.endswith("e") and not verb.endswith(("ee", "ie")):
        ing = verb[:-1] + "ing"
    else:
        ing = verb + "ing"
    return [s, ing]


def base_lexicon() -> dict[str, str]:
    """Form to lemma."""
    out: dict[str, str] = {}
    verbs = dict(_paradigms(VERBS))
    for lemma, forms in verbs.items():
        for f in [*forms, *([] if lemma in ("be", "have", "do", "go", "lie") else _regular(lemma))]:
            out[f] = lemma
        out.setdefault(lemma, lemma)  # lay is a form of lie
    for prefix, bases in PREFIXES.items():
        for b in bases.split():
            for f in [*verbs[b], *_regular(b), b]:
                out[prefix + f] = prefix + b
    for table in (NOUNS, ADJECTIVES):
        for lemma, forms in _paradigms(table):
            for f in [*forms, lemma]:
                out[f] = lemma
    return out


class Lexicon:
    """The built-in forms and a user's own; of a form added twice the last lemma holds."""

    def __init__(self, entries: dict[str, str] | None = None):
        self.entries = base_lexicon() if entries is None else dict(entries)

    def add(self, word: str, lemma: str) -> Lexicon:
        self.entries[word.lower()] = lemma
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.entries.items()), "form string, lemma string")


def lemmatize_words(words: DataFrame, lexicon: Lexicon | None = None, col: str = "word", out: str = "lemma") -> DataFrame:
    """Adds the lemma of a column of words: the lexicon's for its lower-cased form, else the stem."""
    lex = (lexicon or Lexicon()).table(words.sparkSession)
    low = words.withColumn("__low", to_lower(F.col(col)))
    few = len((lexicon or Lexicon()).entries) <= FEW
    joined = stem_words(low, "__low", "__stem").join(F.broadcast(lex) if few else lex, F.col("__low") == F.col("form"), "left")
    return joined.withColumn(out, F.coalesce("lemma", "__stem")).select(*words.columns, out)
