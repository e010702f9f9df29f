"""English gendered pairs and the standard forms of gender values."""

from __future__ import annotations

#: Fixed values: (part of speech, male, female); the published pair lists joined, without repeats.
ENGLISH_PAIRS = [
    ("NOUN", "actor", "actress"), ("NOUN", "boy", "girl"), ("NOUN", "boyfriend", "girlfriend"), ("NOUN", "boys", "girls"),
    ("NOUN", "father", "mother"), ("NOUN", "fathers", "mothers"), ("NOUN", "gentleman", "lady"), ("NOUN", "gentlemen", "ladies"),
    ("NOUN", "grandson", "granddaughter"), ("PRON", "he", "she"), ("PRON", "him", "her"), ("PRON", "his", "her"),
    ("NOUN", "husbands", "wives"), ("NOUN", "kings", "queens"), ("NOUN", "male", "female"), ("NOUN", "males", "females"),
    ("NOUN", "man", "woman"), ("NOUN", "men", "women"), ("NOUN", "prince", "princess"), ("NOUN", "son", "daughter"),
    ("NOUN", "sons", "daughters"), ("NOUN", "spokesman", "spokeswoman"), ("NOUN", "stepfather", "stepmother"), ("NOUN", "uncle", "aunt"),
    ("NOUN", "husband", "wife"), ("NOUN", "king", "queen"), ("NOUN", "brother", "sister"), ("NOUN", "brothers", "sisters"),
    ("NOUN", "hero", "heroine"), ("PROPN", "mr.", "mrs."), ("PROPN", "mr", "mrs"), ("PROPN", "Mr.", "Mrs."), ("PROPN", "Mr", "Mrs"),
]

#: Property values that stand for male, for female, or (in both lists) for either.
MALE_VALUES = [
    "Male", "Feminine & Masculine", "M", "Female , Male", "Male ♂", "Male And Female", "Men'S", "Coeducational", "Man'S High School",
    "Co-Educational", "Males And Females", "Coeducation", "Male9", 'Androgynous, But Can Choose To Be Male Or Female, Or "Both Or Neither"',
    "Simulated Male", "Male\nNickname = The Rigg", "Mixed-Sex_Education", "Female, Unisex", "Boys", "Males", "All-Male", "Mixed", "Boy",
    "All Boy", "Masculine", "Boys And Girls", "Co-Ed",
]
FEMALE_VALUES = [
    "Feminine & Masculine", "Female , Male", "Male And Female", "Coeducational", "Co-Educational", "Males And Females", "Coeducation",
    "Women", 'Androgynous, But Can Choose To Be Male Or Female, Or "Both Or Neither"', "F", "Female", "Girls", "Mixed-Sex_Education",
    "Female, Unisex", "Mixed", "Girl", "Women'S", "W", "Boys And Girls", "Co-Ed",
]


def english_lexicon(order: tuple[str, str] = ("male", "female")) -> dict[str, dict[str, list[str]]]:
    """{group: {part of speech: words}}, groups in the given order."""
    out: dict[str, dict[str, list[str]]] = {g: {} for g in order}
    for pos, *pair in ENGLISH_PAIRS:
        for group, word in zip(order, pair):
            words = out[group].setdefault(pos, [])
            if word not in words:
                words.append(word)
    return out


def gender_standard() -> dict[str, list[str]]:
    """{property value: genders} for the knowledge-base sensor."""
    out: dict[str, list[str]] = {}
    for gender, values in (("male", MALE_VALUES), ("female", FEMALE_VALUES)):
        for v in values:
            out.setdefault(v, []).append(gender)
    return out
