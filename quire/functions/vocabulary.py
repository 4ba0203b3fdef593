"""Word lists: scholarly terms that are no errors, known misreadings, affixes."""

from __future__ import annotations

#: Terms that error detection passes over.
DETECTION = frozenset(
    """
    absurdo aletheia alia aller als angst ante aporia arche aufhebung augenblick avoir bedeutsamkeit befinden befindlichkeit bei bellum bewandtnis
    bricolage circa dasein deconstruction devoir différance dire dissemination doxa dynamis dürfen eidos eigentlichkeit energeia entelechy
    entschlossenheit entwurf episteme erasure ereignis ergo erschlossenheit ethos extremis facto faire faktizität falloir fortiori fraternité furcht für
    generis genesis gerede geschichtlichkeit gestell gewissen geworfenheit haben hyle ibid idem infinitum initio innerweltlich ipso iterability jouissance
    jure kinesis können lassen liberté limine logocentrism logos mit mitsein mitwelt morphe mortem mögen müssen nach nicht nihilo noesis nous oder ousia
    passim pathos per phallogocentrism pharmakon phronesis physis polis post posteriori pouvoir pragma praxis prendre priori psyche qua quasi quo rede
    savoir schuld sein selbstwelt sic situ sollen sorge status stimmung supplementarity techne telos theoria trace umwelt und uneigentlichkeit venir
    verfallenheit versa verstehen versus via vice vitro vivo viz voir von vorhandenheit vorhandensein vouloir weltlichkeit werden wiederholung wollen
    zeitlichkeit zuhandenheit zuhandensein égalité être über
    """.split()
) | {"sous rature"}

#: Terms that correction and quality scores pass over.
CORRECTION = frozenset(
    """
    aber absurdum abyme accidens actus adorno aesthetic aesthetics agape al aletheia als an anschauung ante antinomies antinomy apodeictic apodictic
    aporetic aporia aporias apperception arbitrium arche archē arete aristotle ataraxia au auch auf aufheben aufhebung aus autre autrui aux avant avec
    axiological badiou beautiful beauvoir begriff begriffe bei berkeley besoin bildung bona bracketing bricolage bricoleur camus carnap categorial
    categorical catharsis causa causae ceteris chose choses chronos circa cogitans cogito contra corps corpus cosmos dans das dasein dass de
    deconstruction deduction deleuze dem demande demiurge demiurgos den denken denn der derrida des descartes determinate dialectic dialectical die
    differance différance ding dinge dissemination donc doxa du dunamis dynamis désir eidetic eidos ein eine einem einen einer en energeia ens entelecheia
    entelechy entre episteme epistemological epistemology epoche epoché ergo erkenntnis erkenntnisse erlebnis eros erscheinung erscheinungen espace esprit
    esse est et etc ethos eudaimonia existential existentiale extensa facie facticity facto fallenness fichte fide finis fortiori foucault frege freiheit
    für gadamer garde gedanke gegenstand gegenstände geist generis grammatology grapheme grund gründe guattari habeas haben habermas hat hatte hatten
    hegel heidegger hermeneutic hermeneutical hermeneutics hexis hobbes horizonal horkheimer hume husserl hyle hyletic hylomorphism hymen hypostasis ibid
    ibiden idem ihr ihre imaginaire immanence immanent immediacy in indeterminate infra intellectus intentionality intersubjective intersubjectivity
    intuition intuitions ipso ist iterability jouissance judgement judgment jure kairos kann kant kategoria kategoriai kierkegaard kosmos kripke können la
    lacan le lebenswelt leibniz les levinas liberum locke logocentrism logoi logos mais mala manifold mediation mens merleau metaphysical metaphysics
    mimesis mise mit modus moi monde mondes montesquieu morphe morpheme mort muss mutandis mutatis mythos möglichkeit müssen nach natura naturans naturata
    negation nicht nietzsche nihilo noch noema noematic noesis noetic nom non notwendigkeit noumena noumenon nous nozick nur ob objet oder oeuvre ontic
    ontological ontology operandi ou ousia par paralogism paribus parole passim pathos per petit petitio pharmakon phenomenal phenomenological
    phenomenology philia philo phoneme phonocentrism phonologism physis plato pneuma poiesis polis politeia ponens ponty post posteriori potentia pour
    praxis prima principii priori pro psyche purposiveness père qua quine quod raison rasa ratio raum rawls rea reductio res reus rien rorty rousseau
    russell räumlich réel sans sartre saussure saussurean schelling schematism schon schopenhauer scientificity scène se seiende seiendes sein
    semiological semiology semiotic semiotics sens sensibility sic sich signifiant signified signifier signifié sind socrates soi sont sophia sous spinoza
    sprache sprechen subjectivité sublation sublime substantia sui sujet sum supersensible supplementarity supra sur symbolique tabula techne teleological
    teleology telos temps theoria thrownness tollens totality tout trace transcendence transcendent transcendental um un und understanding une unter
    urteil urteile vernunft verstand verstehen vide vie virtù vivendi viz voluntas von vorstellung vorstellungen wahrheit wahrnehmung war waren weil welt
    weltanschauung welten wenn werden wesen wesentlich wille willen wird wirklichkeit wittgenstein zeit zeitgeist zeitlich zizek zu zwischen écriture
    étaient était être über œuvre
    """.split()
)

#: Misreadings of frequent words and what they stand for.
MISREADINGS = dict(
    x.split("=") for x in "arid=and bccn=been bcing=being beautlful=beautiful conld=could hare=have rnorning=morning shonld=should tbe=the thar=that thcir=their tills=this wonld=would".split()
)

#: Endings and beginnings in the order in which they are tried, with the confidence that a known rest gives.
SUFFIXES = [(x, s) for s, group in ((0.9, "s es"), (0.85, "ed ing"), (0.8, "ly"), (0.7, "tion ment ness ity"), (0.6, "al ive ous"), (0.85, "izes ises ized ised izing ising")) for x in group.split()]
PREFIXES = [(x, s) for s, group in ((0.8, "un re"), (0.7, "pre non"), (0.6, "anti over under")) for x in group.split()]

#: Endings and an inner part of words of other languages.
FOREIGN_ENDINGS = tuple(sorted("ung heit keit lich isch ieren eux oux ique ologie ismus iae orum ae".split()))
FOREIGN_INNER = "sch"

#: Words that a survey takes for valid whatever they look like, and replacements of confused letters and words, in order: constants of the rules that this package keeps to.
COMMON = frozenset(
    "aber and answer argument been being chapter concept conclusion consciousness dasein durch existence experience from have index introduction knowledge logos mind nature nicht notes nous oder philosophy physis polis "
    "question reality reason section sein techne that the theory this thought truth wenn which with world".split()
)
CONFUSED = (
    ("rn", "m"), ("cl", "d"), ("tl", "ti"), ("Beautlful", "Beautiful"), ("beautlful", "beautiful"), ("rnorning", "morning"), ("cloing", "doing"), ("tbat", "that"), ("wbich", "which"), ("bave", "have"), ("judgrnent", "judgment"),
    ("judgrment", "judgment"),
)
