"""Names, streets, towns and sentences that training never has."""

from tallyweave.llm import pii_examples as ex
from tallyweave.llm import pii_tagger as pt

OUTSIDE = {
    "INVENTED": 0,
    "WORD_NAMES": 0,
    "GIVEN": "Alice Bruno Candice Derek Esther Fiona Gustav Hannah Igor Jasmine Kevin Laura Martina Nora Oliver Patricia Quincy Roberto Susannah Tomás Uma Vincent Wendy Xavier Yvonne Zachary Françoise Björn Chloé Rahul Dorothy Walter Brenda Gerald Yolanda Ludwig Elfriede Nathalie Gaspard Consuelo Ramón Pilar Giulia Tadeusz Svetlana Kemal Nasreen Deepak Mei Takeshi".split(),
    "FAMILY": "Blackwell Carson Dunmore Fairfax Goldstein Hamilton Johnston Kirkland Langley Morrison Newton Oldfield Patterson Ringwald Turnbull Westwood Baldwin Calderón Vogel Lehmann Huber Winkler Lindqvist Bergström Dupont Leroy Rousseau Perrault Ortega Castillo Navarro Giménez Conti Greco Barbieri Teixeira Almeida Zieliński Dvořák Kiss Georgiou Volkov Aydın Chaudhry Mukherjee Banerjee Huang Nakamura Ishikawa Pham Obi Sorensen Mäkinen Gallagher Sutherland Whitfield Ashdown".split(),
    "TOWNS": ["Bristol", "Hamburg", "Toulouse", "Sevilla", "Leeds", "Freiburg", "Nantes", "Toledo", "Port Arthur", "Bad Tölz"],
    "EN_STREETS": ["Lavender", "Albert", "Chapel", "Prince's", "Harbour", "Willow Brook", "Fir Tree", "Kingsway", "Priory", "Balmoral", "North Gate", "Sycamore"],
    "DE_STREETS": "Schiller Linden Rosen Ziegel Brunnen Tannen Friedrich Markt".split(),
    "FR_STREETS": ["de la Liberté", "du Maréchal Foch", "des Acacias", "de l'Abbaye", "du Moulin", "Pasteur"],
    "ES_STREETS": ["de la Libertad", "del Río", "de los Olivos", "de Cervantes", "de la Fuente"],
    "ORG_WORDS": "Brewery Dairy Optics Robotics Plumbing Cement Ceramics Fashion".split(),
    "ROLES": "Patron Caller Resident Widow Commuter Registrant Lodger Addressee Proprietor Borrower".split(),
    "TOPICS": ["billing error", "late fee", "wrong meter", "second reminder", "leaflet", "warranty"],
}
# sentences with persons' data, and sentences without, of other wording than the frames
PATTERNS = """Please tell {N} that help is on its way.
I had a long talk with {N} yesterday about {X}.
{N} has requested mail at {E} from today.
Kindly hand the box to {N} at {A}{U}.
A text from {P} mentioned that {N} won the draw.
The registrar copied {I} out of the papers of {N}.
Did {N} ever sleep at {A}{U}?
{J} {N} could not remember {I}.
It is {P} for emergencies and {E} for anything else.
Our driver waited at {A}{U} until {H}.
Whom did {N} phone, {N} or {N}?
Moderator: {N}\nGuests: {N}, {N}
Hi team, {N} here - my cell is {P}.
{N} und {N} heiraten am {D} in {T}.
Frag doch bitte {N}, ob {A}{U} stimmt.
Nous avons croisé {N} devant {A}{U}.
Le numéro {P} appartient à {N}.
Conocí a {N} en casa de {N}, {A}{U}.
Mi hermana {N} usa {E}.
{N} lost a purse with {I} and {M} inside.""".split("\n")
PLAIN = """The bakery in {T} sells bread for {M}.
{O} hired {#} people in {T}.
Snow fell on {D} and roads were shut until {H}.
Our printer model {K} needs toner {X}.
Tickets for row {#} cost {M}.
{O} merged with {O} on {D}.
Press {#} to hear the menu again.
The museum lists {#} works, among them {K}.""".split("\n")


def scores(weights, n=1500):
    m = ex.Maker(77)
    rows = [m.fill(PATTERNS[i % len(PATTERNS)]) + m.r.choice([" ", "\n"]) + m.fill(PLAIN[i % len(PLAIN)]) for i in range(n)]
    texts, gold = zip(*map(ex.unmark, rows))
    found = pt.find_spans(weights, list(texts))
    out = {}
    for kind in pt.TYPES:
        a = {(d, *s) for d, x in enumerate(gold) for s in x if s[0] == kind}
        b = {(d, *s) for d, x in enumerate(found) for s in x if s[0] == kind}
        out[kind] = (len(a), len(a & b) / len(a), len(a & b) / len(b))
    return out


def test_names_and_sentences_that_training_never_saw(monkeypatch):
    w = pt.default_weights()
    for k, v in OUTSIDE.items():
        if isinstance(v, list):
            assert not {x.casefold() for x in getattr(ex, k)} & {x.casefold() for x in v}, k
        monkeypatch.setattr(ex, k, v)
    assert not set(PATTERNS + PLAIN) & set(ex.POSITIVE + ex.NEGATIVE)
    got = scores(w)
    print(got)
    assert all(n >= 200 for n, _, _ in got.values())
    assert got["NAME"][1] > 0.9 and got["NAME"][2] > 0.9
    assert all(r > 0.9 and p > 0.9 for _, r, p in got.values())


def test_plain_sentences_with_common_names():
    w = pt.default_weights()
    names = "Alice Blackwell,Kevin Langley,Hannah Vogel,Roberto Castillo,Chloé Rousseau,Deepak Mukherjee,Takeshi Nakamura,Svetlana Volkov,Patricia Hamilton,Gustav Lindqvist,Laura Bianco,Omar Farouk,Mei Lin,Fatima Zahra,Carlos Mendes,Ingeborg Haas,Brenda Walsh,Dmitry Sokolov,Aaliyah Johnson,Pedro Alves".split(",")
    frames = ["I met {} at noon.", "The letter is for {}.", "{} was not at home.", "Please call {} back.", "Signed: {}", "Granted by {} on 2026-01-15.", "Written by {} on 12 May 2026.", "Today {} and her lawyer appeared.", "We gave {} a new key.", "Is {} the owner?"]
    cases = [(n, f.format(n)) for n in names for f in frames]
    hits = sum(("NAME", t.find(n), t.find(n) + len(n)) in s for (n, t), s in zip(cases, pt.find_spans(w, [t for _, t in cases])))
    assert hits >= 174, hits  # of 200
