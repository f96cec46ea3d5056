"""Word lists of the generators and evaluators. Fixed values."""

ANY_ADVERB_BUT = {"follows": {"secretly"}, "greets": {"secretly"}}
ANIMATE_ONLY = {"greet", "call", "help"}

#: Words of relative clauses, questions and pairs.
CLAUSE = {
    "n1": ["boy", "student", "doctor", "artist", "athlete"],
    "n2": ["girl", "child", "professor", "scientist", "neighbor"],
    "verbs": [("sees", "see"), ("admires", "admire"), ("avoids", "avoid"), ("observes", "observe"), ("greets", "greet")],
    "adj1": ["big", "tall", "young", "strong", "kind"],
    "adj2": ["beautiful", "smart", "brave", "famous", "honest"],
    "adverbs": ["possibly", "apparently", "secretly", "always", "often", "rarely"],
    "tail_singular": ["is eating an apple", "is watching a movie", "is reading a book", "likes to dance", "enjoys music", "likes climbing"],
    "tail_plural": ["are eating an apple", "are watching a movie", "are reading a book", "like to dance", "enjoy music", "like climbing"],
}
QUESTION_VERBS = [
    ("see", "saw", "seeing"), ("admire", "admired", "admiring"), ("avoid", "avoided", "avoiding"), ("observe", "observed", "observing"), ("greet", "greeted", "greeting"),
]
PAIR = {
    "n2": ["girl", "child", "pilot", "scientist", "engineer"],
    "verbs": [("visits", "visit"), ("helps", "help"), ("avoids", "avoid"), ("follows", "follow"), ("greets", "greet")],
}

#: Words of the factorial sets.
PREPOSITIONS = ["near", "beside", "behind", "with"]
FACTORIAL_CLAUSE = {
    "iv": {
        "n1": ["boy", "student", "doctor", "artist", "athlete"],
        "n2": ["girl", "child", "professor", "scientist", "neighbor"],
        "tails": ["is happy", "is tired", "is sleeping", "is smart", "is tall"],
        "objects": {
            "sees": ["crowds", "friends", "peers", "staff", "teams"],
            "admires": ["leaders", "poets", "peers", "heroes", "fans"],
            "avoids": ["crowds", "noise", "trouble", "conflict", "stress"],
            "observes": ["trends", "birds", "rules", "crowds", "signs"],
            "greets": ["guests", "fans", "friends", "staff", "crowds"],
        },
    },
    "oov": {
        "n1": ["stranger", "passenger", "prisoner", "soldier", "customer"],
        "n2": ["winner", "victim", "scholar", "tourist", "patron"],
        "tails": ["is angry", "is anxious", "is silent", "is nervous", "is peaceful"],
        "objects": {
            "ignores": ["rules", "warnings", "signals", "advice", "feedback"],
            "examines": ["files", "records", "samples", "papers", "details"],
            "inspires": ["readers", "crowds", "pupils", "viewers", "members"],
            "protects": ["rights", "assets", "zones", "borders", "lands"],
            "describes": ["events", "images", "patterns", "features", "plans"],
        },
    },
}
NO_FILLERS = ["This", "That", "It", "He", "She"]
FACTORIAL_QUESTION = {
    "iv": {
        "nouns": ["boy", "student", "doctor", "artist", "athlete", "girl", "child", "professor", "scientist", "neighbor"],
        "objects": {
            "seeing": ["crowds", "friends", "birds", "signs", "stars"],
            "admiring": ["peers", "leaders", "heroes", "fans", "crowds"],
            "avoiding": ["crowds", "noise", "trouble", "conflict", "stress"],
            "observing": ["birds", "trends", "rules", "crowds", "flags"],
            "greeting": ["guests", "fans", "friends", "staff", "crowds"],
        },
    },
    "oov": {
        "nouns": ["stranger", "passenger", "prisoner", "soldier", "customer", "winner", "victim", "scholar", "tourist", "patron"],
        "objects": {
            "ignoring": ["rules", "warnings", "signals", "advice", "feedback"],
            "examining": ["files", "records", "samples", "papers", "details"],
            "inspiring": ["readers", "crowds", "pupils", "viewers", "members"],
            "preferring": ["options", "items", "choices", "styles", "methods"],
            "describing": ["events", "images", "patterns", "features", "plans"],
        },
    },
}

#: Nouns, verbs and tails of the transitivity and distractor sets, and the objects that fit each verb.
ANIMATE_1 = ["boy", "girl", "student", "doctor", "artist", "nurse", "pilot", "officer"]
ANIMATE_2 = ["girl", "boy", "child", "guard", "judge", "patient", "client", "tourist"]
INANIMATE_1 = ["car", "house", "book", "phone", "table", "door", "ball", "stone", "bridge", "train", "cup", "bag"]
TRANSITIVE = ["sees", "knows", "likes", "helps", "follows", "watches", "visits", "calls"]
INTRANSITIVE = ["sleeps", "laughs", "cries", "smiles", "yawns", "sits", "waits", "nods"]
TAILS = ["is here", "is old", "is new", "is nearby", "is interesting", "matters", "is well known", "is important"]
INANIMATE_OBJECTS = {
    "eats": ["pizza", "cake", "bread", "apple", "soup"],
    "reads": ["book", "paper", "letter", "mail"],
    "builds": ["house", "bridge", "table", "door", "wall"],
    "drives": ["car", "truck", "bus", "train"],
    "fixes": ["car", "door", "phone", "bike"],
    "opens": ["door", "window", "bottle", "box"],
    "breaks": ["window", "door", "phone", "cup"],
    "lifts": ["box", "stone", "bag", "table"],
    "throws": ["ball", "stone", "bag", "book"],
}
ANIMATE_OBJECTS = {
    "hires": ["doctor", "nurse", "pilot", "officer", "guard"],
    "meets": ["doctor", "student", "pilot", "officer", "judge"],
    "trusts": ["doctor", "student", "pilot", "officer", "judge"],
    "greets": ["doctor", "student", "pilot", "officer", "tourist"],
    "thanks": ["doctor", "student", "pilot", "officer", "nurse"],
    "helps": ["doctor", "student", "pilot", "officer", "guard"],
    "calls": ["doctor", "student", "pilot", "officer", "nurse"],
    "knows": ["doctor", "student", "pilot", "officer", "guard"],
}

#: Candidates after a clause and after a question.
CANDIDATES_CLAUSE = {
    "iv": {
        "nouns": ["boy", "student", "doctor", "artist", "athlete", "girl", "child", "monk", "guard", "clerk"],
        "adjectives": ["big", "tall", "young", "strong", "kind", "beautiful", "smart", "brave", "famous", "honest"],
        "tails": CLAUSE["tail_singular"] + CLAUSE["tail_plural"],
    },
    "oov": {
        "nouns": ["judge", "nurse", "cook", "chef", "baker", "pilot", "sailor", "hunter", "trader", "ranger"],
        "adjectives": [],
        "tails": ["is angry", "is anxious", "is silent", "is nervous", "is peaceful", "are angry", "are anxious", "are silent", "are nervous", "are peaceful"],
    },
}
CANDIDATES_QUESTION = {
    "iv": {
        "nouns": ["man", "dancer", "singer", "writer", "knight", "woman", "lord", "king", "queen", "pope"],
        "adjectives": ["old", "short", "thin", "bold", "lean", "wise", "noble", "proud", "calm", "loyal"],
        "verbs": [("know", "knew", "knowing"), ("keep", "kept", "keeping"), ("lead", "led", "leading"), ("make", "made", "making"), ("send", "sent", "sending")],
    },
    "oov": {
        "nouns": ["miner", "farmer", "rider", "driver", "painter", "fighter", "builder", "healer", "manager", "officer"],
        "adjectives": [],
        "verbs": [("hold", "held", "holding"), ("take", "took", "taking"), ("give", "gave", "giving"), ("pull", "pulled", "pulling"), ("show", "showed", "showing")],
    },
}

#: Learning rate, warm-up steps, batch size, weight decay, clip norm; and rate, warm-up ratio, decay, batch size.
GRID = {"lr": [1e-5, 2e-5, 5e-5], "warmup": [500, 2116], "batch": [8, 16], "wd": [0.0, 0.01], "clip": [0.5, 1.0]}
SEARCH_GRID = {"lr": [1e-5, 3e-5, 5e-5], "wu": [0.0, 0.05, 0.1], "wd": [0.0, 0.01], "bs": [8, 16, 32]}

#: Weights of the sources c4, orc, wh and svo by run: nine runs on web text, five on child-directed speech.
MIXTURES = {
    "orc_05_ckpt": (0.97, 0.005, 0.0, 0.025),
    "orc_1_ckpt": (0.97, 0.01, 0.0, 0.02),
    "orc_3_ckpt": (0.97, 0.03, 0.0, 0.0),
    "wh_05_ckpt": (0.97, 0.0, 0.005, 0.025),
    "wh_1_ckpt": (0.97, 0.0, 0.01, 0.02),
    "wh_3_ckpt": (0.97, 0.0, 0.03, 0.0),
    "baseline_ckpt": (0.97, 0.0, 0.0, 0.03),
    "orc_01_ckpt": (0.97, 0.001, 0.0, 0.029),
    "wh_01_ckpt": (0.97, 0.0, 0.001, 0.029),
    "childes_5_5": (0.0, 0.05, 0.05, 0.9),
    "childes_4_6": (0.0, 0.04, 0.9, 0.06),
    "childes_6_4": (0.0, 0.06, 0.04, 0.0),
    "childes_wh": (0.0, 0.0, 0.1, 0.9),
    "childes_orc": (0.0, 0.1, 0.0, 0.9),
}

#: Names in the step summary.
TERMS = [
    "anaphor_agreement", "argument_structure", "binding", "control_raising", "determiner_noun_agreement", "ellipsis", "filler_gap_dependency",
    "irregular_forms", "island_effects", "npi_licensing", "quantifiers", "s-selection", "subject_verb_agreement",
]
AGREEMENTS = ["plural_plural", "plural_singular", "singular_plural", "singular_singular"]


def summary_fields() -> list[str]:
    """The metrics of a step in the summary's order."""
    return [
        "blimp_accuracy", *(f"blimp_{t}" for t in TERMS), "nested_inner_accuracy", "nested_outer_accuracy", *(f"nested_{s}_{c}" for s in ("inner", "outer") for c in AGREEMENTS),
        *(f"filler_gap_{t}_{v}_interaction" for t in ("orc", "wh") for v in ("iv", "oov")), *(f"prob_mass_{t}_{v}_{k}" for t in ("orc", "wh") for v in ("iv", "oov") for k in ("NP", "VP", "qm")),
    ]
