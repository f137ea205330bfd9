"""Phonetic tables. Fixed values throughout: symbols and spellings that results depend on, in natural order."""

from __future__ import annotations

# Devanagari vowels, consonants, vowel signs, and consonants that a nukta changes, as phonemes.
DEVA_VOWELS = {"अ": "ə", "आ": "aː", "इ": "ɪ", "ई": "iː", "उ": "ʊ", "ऊ": "uː", "ऋ": "ri", "ए": "eː", "ऐ": "ɛː", "ओ": "oː", "औ": "ɔː", "ऍ": "æ", "ऑ": "ɒ"}
DEVA_CONSONANTS = {
    "क": "k", "ख": "kʰ", "ग": "ɡ", "घ": "ɡʱ", "ङ": "ŋ",
    "च": "tʃ", "छ": "tʃʰ", "ज": "dʒ", "झ": "dʒʱ", "ञ": "ɲ",
    "ट": "ʈ", "ठ": "ʈʰ", "ड": "ɖ", "ढ": "ɖʱ", "ण": "ɳ",
    "त": "t̪", "थ": "t̪ʰ", "द": "d̪", "ध": "d̪ʱ", "न": "n",
    "प": "p", "फ": "pʰ", "ब": "b", "भ": "bʱ", "म": "m",
    "य": "j", "र": "r", "ल": "l", "व": "ʋ", "श": "ʃ", "ष": "ʂ", "स": "s", "ह": "ɦ",
}
DEVA_SIGNS = {"ा": "aː", "ि": "ɪ", "ी": "iː", "ु": "ʊ", "ू": "uː", "ृ": "ri", "े": "eː", "ै": "ɛː", "ो": "oː", "ौ": "ɔː", "ॅ": "æ", "ॉ": "ɒ"}
NUKTA_CONSONANTS = {"ज": "z", "फ": "f", "क": "q", "ख": "x", "ग": "ɣ", "ड": "ɽ", "ढ": "ɽʱ"}
VIRAMA, NUKTA, ANUSVARA, VISARGA, CANDRABINDU = "्", "़", "ं", "ः", "ँ"
# Letters that normal form C keeps apart: letter and its decomposition.
NUKTA_LETTERS = {chr(0x0958 + k): base + NUKTA for k, base in enumerate("कखगजडढफय")}
NASAL = "̃"
VOWEL_LETTERS = "əaiueoɛɔɒæɪʊ"

# English words by pronunciation.
ENGLISH_WORDS = {
    "the": "ðə", "a": "ə", "an": "ən", "is": "ɪz", "are": "ɑːr", "and": "ænd", "of": "ʌv", "to": "tuː", "in": "ɪn", "on": "ɒn", "for": "fɔːr",
    "stochastic": "stəˈkæstɪk", "cepstrum": "ˈkɛpstrəm", "fourier": "ˈfʊrieɪ", "transform": "ˈtrænsfɔːrm", "spectrum": "ˈspɛktrəm", "phoneme": "ˈfoʊniːm",
    "mel": "mɛl", "filter": "ˈfɪltər", "bank": "bæŋk", "hidden": "ˈhɪdən", "markov": "ˈmɑːrkɒv", "model": "ˈmɒdəl", "viterbi": "vɪˈtɜːrbi", "dynamic": "daɪˈnæmɪk",
    "time": "taɪm", "warping": "ˈwɔːrpɪŋ", "speech": "spiːtʃ", "recognition": "ˌrɛkəɡˈnɪʃən", "whisper": "ˈwɪspər", "wav": "wæv", "vec": "vɛk",
    "transformer": "trænsˈfɔːrmər", "attention": "əˈtɛnʃən", "encoder": "ɛnˈkoʊdər", "decoder": "diːˈkoʊdər", "pitch": "pɪtʃ", "formant": "ˈfɔːrmənt",
    "ipa": "aɪ piː eɪ", "hmm": "eɪtʃ ɛm ɛm", "vits": "vɪts", "yourtts": "jɔːr tiː tiː ɛs", "mcd": "ɛm siː diː", "wer": "dʌbəljuː iː ɑːr",
    "eer": "iː iː ɑːr", "lfcc": "ɛl ɛf siː siː", "cqcc": "siː kjuː siː siː", "dtw": "diː tiː dʌbəljuː", "hello": "həˈloʊ", "class": "klæs", "lecture": "ˈlɛktʃər",
    "today": "təˈdeɪ", "will": "wɪl", "discuss": "dɪˈskʌs", "signal": "ˈsɪɡnəl", "processing": "ˈprɒsɛsɪŋ",
}
# Letter rules, the first that fits counts.
LETTER_RULES = {
    "tion": "ʃən", "sion": "ʒən", "sch": "sk", "ch": "tʃ", "sh": "ʃ", "th": "θ", "ph": "f", "ng": "ŋ", "ck": "k", "qu": "kw",
    "ee": "iː", "ea": "iː", "oo": "uː", "ou": "aʊ", "ow": "aʊ", "oa": "oʊ", "ai": "eɪ", "ay": "eɪ", "oy": "ɔɪ", "oi": "ɔɪ",
    "a": "æ", "e": "ɛ", "i": "ɪ", "o": "ɒ", "u": "ʌ", "y": "i", "b": "b", "c": "k", "d": "d", "f": "f", "g": "ɡ", "h": "h", "j": "dʒ", "k": "k", "l": "l",
    "m": "m", "n": "n", "p": "p", "r": "r", "s": "s", "t": "t", "v": "v", "w": "w", "x": "ks", "z": "z",
}
# Replacements for Latin words, in order.
LATIN_FIXUPS = [("ʋ", "v"), ("t̪", "t"), ("d̪", "d"), ("ɳ", "n"), ("ʂ", "ʃ"), ("ə ʃ", "əʃ")]

# Phonemes as Devanagari; vowels and diphthongs as independent letters and as signs.
IPA_CONSONANTS = {
    "p": "प", "pʰ": "फ", "b": "ब", "bʱ": "भ", "m": "म", "t": "ट", "t̪": "त", "tʰ": "ठ", "t̪ʰ": "थ", "d": "ड", "d̪": "द", "dʱ": "ध", "d̪ʱ": "ध", "n": "न", "ɳ": "ण",
    "k": "क", "kʰ": "ख", "ɡ": "ग", "ɡʱ": "घ", "ŋ": "ङ", "tʃ": "च", "tʃʰ": "छ", "dʒ": "ज", "dʒʱ": "झ", "ɲ": "ञ", "ʈ": "ट", "ʈʰ": "ठ", "ɖ": "ड", "ɖʱ": "ढ",
    "f": "फ़", "v": "व", "ʋ": "व", "s": "स", "z": "ज़", "ʃ": "श", "ʂ": "ष", "h": "ह", "ɦ": "ह", "j": "य", "r": "र", "ɽ": "ड़", "l": "ल", "w": "व", "θ": "थ", "ð": "द",
}
IPA_VOWELS = {
    "ə": ("अ", ""), "a": ("अ", ""), "aː": ("आ", "ा"), "ɑ": ("आ", "ा"), "ɪ": ("इ", "ि"), "i": ("इ", "ि"), "iː": ("ई", "ी"), "ʊ": ("उ", "ु"), "u": ("उ", "ु"), "uː": ("ऊ", "ू"),
    "e": ("ए", "े"), "eː": ("ए", "े"), "ɛ": ("ऐ", "ै"), "ɛː": ("ऐ", "ै"), "æ": ("ऐ", "ै"), "o": ("ओ", "ो"), "oː": ("ओ", "ो"), "ɒ": ("औ", "ौ"), "ɔ": ("औ", "ौ"), "ɔː": ("औ", "ौ"), "ʌ": ("अ", ""),
}
IPA_DIPHTHONGS = {"eɪ": ("ए", "े"), "aɪ": ("आइ", "ाइ"), "ɔɪ": ("आइ", "ाइ"), "aʊ": ("आउ", "ाउ"), "oʊ": ("ओ", "ो")}
PUNCTUATION = ",.!?;:-"

# Vowel formants in Hz.
FORMANTS = {
    "ə": (500, 1500, 2500), "a": (750, 1150, 2600), "aː": (800, 1170, 2600), "ɑ": (770, 1100, 2500), "i": (280, 2250, 2900), "iː": (300, 2300, 3000), "ɪ": (400, 1900, 2570),
    "u": (380, 950, 2300), "uː": (320, 870, 2400), "ʊ": (500, 1000, 2400), "e": (480, 1850, 2600), "eː": (450, 1900, 2700), "ɛ": (550, 1770, 2490), "ɛː": (550, 1700, 2600),
    "o": (500, 900, 2400), "oː": (450, 820, 2400), "ɔ": (590, 880, 2540), "ɔː": (600, 900, 2600), "æ": (660, 1700, 2400), "ɒ": (550, 800, 2500),
}

# Terms that a decoder favours.
BOOST_TERMS = ("cepstrum", "stochastic", "mel", "viterbi", "hmm", "fft", "formant", "pitch", "phoneme", "ipa", "wav2vec", "whisper", "vits", "yourtts", "mcd", "wer", "eer", "lfcc", "cqcc", "dtw")
# Heads and modifiers of compound dictionary entries.
HEADS = ["spectrum", "filter", "model", "network", "layer", "frequency", "error", "signal", "window", "frame", "rate", "state"]
MODIFIERS = [
    "mel", "linear", "hidden", "random", "neural", "phoneme", "word", "silence", "noise", "gaussian", "log", "power", "dynamic", "stochastic", "cepstrum", "viterbi", "recognition",
    "synthesis", "prosody", "voice_cloning", "zero_shot", "cross_lingual", "equal_error", "attention", "encoder", "decoder", "transformer", "speaker", "formant", "pitch", "vocoder",
    "algorithm", "optimization", "embedding", "translation", "transcription", "training", "testing", "predict", "label", "data",
]
