"""Class labels that guards and events look for, and words that descriptions use."""

INTERFERENCE_CLASSES = [
    "Speech", "Conversation", "Narration, monologue", "Child speech, kid speaking", "Shout", "Screaming", "Laughter", "Singing",
    "Music", "Musical instrument", "Television", "Radio", "Telephone bell ringing", "Dog", "Cat", "Bird",
]
HUMAN_VOICE_CLASSES = [
    "Speech", "Conversation", "Narration, monologue", "Child speech, kid speaking", "Whispering", "Laughter", "Singing", "Humming",
    "Whistling", "Shout", "Screaming", "Yell",
]
#: feature, label, unit, word for higher, word for lower
DESCRIPTIONS = [
    ("level", "level", "dBFS", "louder", "quieter"),
    ("spectralFlatness", "noisiness", "", "noisier", "more tonal"),
    ("spectralCentroidHz", "spectral centroid", "Hz", "brighter", "duller"),
    ("spectralFlux", "spectral change", "", "less steady", "steadier"),
    ("onsetPeriodicity", "rhythmic regularity", "", "more rhythmic", "less rhythmic"),
    ("amplitudeModulationHz", "modulation rate", "Hz", "faster", "slower"),
    ("amplitudeModulationDepth", "modulation depth", "", "more pulsing", "less pulsing"),
    ("peakFrequencyHz", "strongest tone", "Hz", "higher pitched", "lower pitched"),
    ("peakProminenceDb", "tone prominence", "dB", "more whiny", "less whiny"),
]
