"""Fixed values of the scoring models, as data."""

from __future__ import annotations

# Fixed values: (category, O, C, E, A, N), in the order of summation.
BIG_FIVE_TRAITS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
BIG_FIVE = (
    ("positive_emotion", -0.009, None, 0.006, 0.011, None),
    ("cognitive_process", None, -0.007, None, None, 0.008),
    ("tentative", None, None, None, None, 0.007),
    ("certainty", None, None, None, None, 0.008),
    ("pronoun", -0.013, None, 0.006, None, 0.005),
    ("article", 0.012, None, None, None, -0.007),
    ("achievement", None, 0.008, None, None, None),
    ("social", None, None, 0.009, None, None),
    ("time", -0.013, None, None, 0.007, None),
    ("space", None, None, None, 0.010, None),
    ("motion", -0.013, None, None, 0.008, None),
    ("cause", None, -0.007, None, None, 0.007),
    ("inclusive", 0.007, None, None, 0.011, None),
    ("exclusive", None, -0.010, None, None, None),
    ("past_focus", -0.010, None, None, None, None),
    ("negative_emotion", None, -0.011, None, -0.009, 0.010),
    ("sensation", None, None, None, None, 0.006),
)

# The weights of the other four traits.
REGULATORY_FOCUS = (("promotion_focus", 0.020), ("prevention_focus", -0.020))
NEED_FOR_COGNITION = (("analytic_thinking", 0.025), ("intuitive_thinking", -0.015))
COGNITIVE_STYLE = (
    ("cognitive_process", 0.008),
    ("cause", 0.008),
    ("certainty", 0.008),
    ("big_words", 0.012),
    ("analytic_thinking", 0.010),
    ("sensation", -0.008),
    ("pronoun", -0.008),
    ("present_focus", -0.008),
    ("intuitive_thinking", -0.010),
    ("tentative", -0.006),
)
NEED_FOR_CLOSURE = (("certainty", 0.020), ("tentative", -0.025))
START = 0.50

TRAITS = {t: tuple((row[0], row[k + 1]) for row in BIG_FIVE if row[k + 1] is not None) for k, t in enumerate(BIG_FIVE_TRAITS)} | {
    "regulatory_focus": REGULATORY_FOCUS,
    "need_for_cognition": NEED_FOR_COGNITION,
    "cognitive_style": COGNITIVE_STYLE,
    "need_for_closure": NEED_FOR_CLOSURE,
}

# Summary variables; categories added, categories subtracted, divisor.
SUMMARY = {
    "emotional_tone": (("positive_emotion",), ("negative_emotion",), 5),
    "analytical_thinking": (
        ("article", "cognitive_process", "cause", "certainty", "exclusive", "quantitative"),
        ("pronoun", "tentative", "inclusive", "sensation", "time"),
        8,
    ),
    "clout": (("certainty", "social", "achievement", "exclusive"), ("pronoun", "tentative", "negative_emotion"), 5),
    "authenticity": (
        ("pronoun", "tentative", "present_focus", "inclusive", "sensation"),
        ("big_words", "cognitive_process", "cause", "past_focus", "exclusive", "certainty"),
        6,
    ),
}

# Value orientations and their names.
VALUES = {
    "value_self_direction": "Self-direction",
    "value_stimulation": "Stimulation",
    "value_hedonism": "Hedonism",
    "value_achievement": "Achievement",
    "value_power": "Power",
    "value_security": "Security",
    "value_conformity": "Conformity",
    "value_tradition": "Tradition",
    "value_benevolence": "Benevolence",
    "value_universalism": "Universalism",
}

# Names of traits; labels (above the middle, below it, middle), and whether 0.65 itself is high.
TRAIT_NAMES = {
    "openness": "Openness",
    "conscientiousness": "Conscientiousness",
    "extraversion": "Extraversion",
    "agreeableness": "Agreeableness",
    "neuroticism": "Neuroticism",
    "regulatory_focus": "Regulatory Focus",
    "need_for_cognition": "Need for Cognition",
    "cognitive_style": "Cognitive Style",
    "need_for_closure": "Need for Closure",
}
HIGH, LOW = 0.65, 0.35
TRAIT_LABELS = {t: ("high", "low", "moderate", True) for t in BIG_FIVE_TRAITS} | {
    "regulatory_focus": ("promotion_focus", "prevention_focus", "balanced", False),
    "need_for_cognition": ("high", "low", "moderate", False),
    "cognitive_style": ("systematic", "intuitive", "mixed", False),
    "need_for_closure": ("high", "low", "moderate", False),
}
SUMMARY_LABELS = {
    "analytical_thinking": ("Analytical Thinking", "highly analytical", "intuitive", "moderate"),
    "clout": ("Clout", "confident/dominant", "submissive/uncertain", "moderate"),
    "authenticity": ("Authenticity", "personal/honest", "guarded/distant", "moderate"),
    "emotional_tone": ("Emotional Tone", "positive", "negative", "neutral"),
}
