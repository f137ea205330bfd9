"""The seed dictionary and the sentences of the default language model."""

# Fixed values, one entry a line: term, Ol Chiki, Devanagari, Hindi.
SEED_TERMS = """\
speech	ᱨᱚᱲ	रोड़	भाषण
sound	ᱥᱟᱲᱮ	साड़े	ध्वनि
signal	ᱠᱷᱚᱵᱚᱨ	खबर	संकेत
frequency	ᱦᱤᱲᱤ-ᱦᱤᱲᱤ	हिड़ि-हिड़ि	आवृत्ति
amplitude	ᱢᱟᱨᱟᱝ	मरांग	आयाम
phase	ᱢᱚᱧᱡ	मोञ्ज	प्रावस्था
pitch	ᱥᱩᱨ	सुर	स्वरमान
tone	ᱛᱟᱱ	तान	स्वर
volume	ᱡᱷᱚᱛ	झोत	आयतन
noise	ᱠᱩᱛᱷᱩ	कुथु	शोर
silence	ᱨᱟᱥᱤ	रासि	मौन
voice	ᱠᱚᱞᱚᱢ	कोलोम	आवाज
ear	ᱞᱩᱛᱩᱨ	लुतुर	कान
mouth	ᱢᱚᱪᱟ	मोचा	मुंह
language	ᱯᱟᱹᱨᱥᱤ	पार्सि	भाषा
word	ᱟᱲᱟ	आड़ा	शब्द
sentence	ᱨᱚᱲᱟᱜ	रोड़ाग	वाक्य
syllable	ᱚᱠᱷᱚᱨ-ᱜᱟᱱ	ओखोर-गान	अक्षरगण
phoneme	ᱨᱚᱲᱮ-ᱡᱟᱱᱟ	रोड़े-जाना	ध्वनिमान
grapheme	ᱟᱨ-ᱜᱟᱱ	आर-गान	वर्णग्राम
alphabet	ᱚᱠᱷᱚᱨ-ᱢᱟᱞᱟ	ओखोर-माला	वर्णमाला
consonant	ᱠᱷᱟᱹᱲᱤ-ᱚᱠᱷᱚᱨ	खाड़ि-ओखोर	व्यञ्जन
vowel	ᱥᱩᱨᱤ-ᱚᱠᱷᱚᱨ	सुरि-ओखोर	स्वर
transform	ᱢᱚᱱᱚᱡ	मोनोज	रूपांतर
fourier	ᱯᱷᱩᱨᱤᱭᱮ	फुरिये	फूरिए
spectrum	ᱨᱚᱝ-ᱥᱟᱨᱤ	रोंग-सारि	वर्णक्रम
cepstrum	ᱥᱮᱯᱛᱨᱚᱢ	सेप्त्रोम	सेप्सट्रम
filter	ᱥᱤᱧᱡᱚᱜ	सिञ्जोग	संशोधक
bank	ᱥᱟᱢᱦᱚᱛ	समहोत	समूह
window	ᱫᱩᱟᱹᱨ	दुआर	खिड़की
frame	ᱛᱟᱹᱞᱠᱟ	ताल्का	फ्रेम
hop	ᱮᱢᱚᱡ	एमोज	छलांग
overlap	ᱢᱤᱥᱟᱹ	मिस्सा	अतिव्याप्ति
sampling	ᱱᱟᱢᱩᱱᱟ	नमूना	नमूनाकरण
rate	ᱦᱟᱨ	हर	दर
quantization	ᱜᱟᱱ-ᱡᱚᱜᱟᱹᱣ	गान-जोगाव	परिमाणन
log	ᱞᱚᱜ	लोग	लॉग
power	ᱦᱮᱛ	हेत	शक्ति
energy	ᱟᱹᱠᱥᱤᱛ	आक्सित	ऊर्जा
spectrogram	ᱨᱚᱝ-ᱪᱤᱛᱟᱹᱨ	रोंग-चितार	वर्णलेख
mfcc	ᱮᱢ-ᱮᱯᱷ-ᱥᱤ-ᱥᱤ	एम-एफ-सी-सी	एमएफसीसी
mel	ᱢᱮᱞ	मेल	मेल
model	ᱧᱤᱛᱷᱤ	ञिथि	मॉडल
data	ᱥᱟᱝᱯᱳᱨ	सांगपोर	दत्त
train	ᱪᱮᱛᱟᱱ	चेतन	प्रशिक्षण
test	ᱯᱚᱨᱥᱚ	पोर्सो	परीक्षण
predict	ᱵᱟᱨᱟᱭ	बाराय	पूर्वानुमान
label	ᱪᱤᱱᱦᱟᱹ	चिन्हा	लेबल
loss	ᱜᱟᱯᱟᱹ	गपा	हानि
gradient	ᱥᱚᱠᱟᱢ	सोकाम	प्रवणता
layer	ᱥᱛᱷᱟᱨ	स्थार	परत
network	ᱡᱟᱞ	जाल	जाल
neural	ᱯᱟᱹᱭᱞᱟᱹ-ᱡᱟᱞ	पायला-जाल	तंत्रिका
attention	ᱥᱚᱢᱵᱷᱟᱞ	सोम्भाल	ध्यान
transformer	ᱯᱚᱨᱤᱣᱚᱨᱛᱚᱠ	परिवर्तक	ट्रांसफॉर्मर
encoder	ᱥᱟᱭᱚᱱ	सायोन	कूटक
decoder	ᱥᱟᱭᱚᱱ-ᱨᱤᱯᱷᱤᱛ	सायोन-रिफित	विकूटक
embedding	ᱥᱟᱢᱞᱤᱠ	सामलिक	संलग्नक
loss_function	ᱜᱟᱯᱟᱹ-ᱠᱟᱹᱢᱤ	गपा-काम	हानि-फ़ंक्शन
algorithm	ᱠᱟᱨᱥᱟ	कारसा	कलनविधि
optimization	ᱩᱱᱩᱫᱩᱜ	उनुदुग	अनुकूलन
backprop	ᱵᱮᱠ-ᱯᱨᱚᱯ	बेक-प्रोप	बैकप्रॉप
dropout	ᱫᱨᱚᱯᱟᱣᱚᱴ	ड्रोपआउट	ड्रॉपआउट
recognition	ᱡᱚᱱᱟᱣ	जोनाव	अभिज्ञान
synthesis	ᱥᱚᱢᱵᱤᱞᱟᱹ	सोमबिला	संश्लेषण
transcription	ᱞᱮᱠᱷᱟ	लेखा	लिप्यंतरण
translation	ᱩᱞᱴᱷᱟ	उल्था	अनुवाद
phonetic	ᱥᱚᱨ-ᱟᱲᱟ	सोर-आड़ा	ध्वन्यात्मक
vocoder	ᱥᱚᱨ-ᱛᱚᱨᱡᱚᱨ	सोर-तोरजोर	वोकोडर
vocoder_neural	ᱱᱟᱢᱩᱱᱟ-ᱡᱟᱞ-ᱛᱚᱨᱡᱚᱨ	नमूना-जाल	ढ़न्य-तन्त्र
speaker	ᱠᱚᱞᱚᱢ-ᱫᱟᱨ	कोलोम-दार	वक्ता
speaker_embedding	ᱠᱚᱞᱚᱢ-ᱥᱟᱢᱞᱤᱠ	कोलोम-सामलिक	वक्ता-निवेश
voice_cloning	ᱠᱚᱞᱚᱢ-ᱮᱥᱮᱞ	कोलोम-एसेल	स्वर-प्रतिरूपण
zero_shot	ᱥᱩᱱ-ᱜᱚᱴᱟ	सून-गोटा	शून्य-शॉट
cross_lingual	ᱯᱟᱹᱨᱥᱤ-ᱚᱠᱷᱚᱨ	पार्सि-ओखोर	बहुभाषी
duration	ᱥᱚᱢᱭ	सोमय	अवधि
prosody	ᱡᱷᱩᱢᱨᱟ	झुमरा	छंदोच्चार
rhythm	ᱡᱷᱩᱢᱩᱲ	झुमुड़	लय
intonation	ᱠᱚᱞᱚᱢ-ᱥᱤᱢᱛᱟ	कोलोम-सिम्ता	स्वराघात
stress	ᱫᱟᱹᱯᱟᱹ	दापा	बल
vocal	ᱢᱩᱢᱩᱴ	मुमूट	कण्ठ
tract	ᱱᱟᱨ	नार	नलिका
vocal_tract	ᱢᱩᱢᱩᱴ-ᱱᱟᱨ	मुमूट-नार	कण्ठनलिका
formant	ᱨᱚᱝ-ᱠᱷᱟᱹᱯ	रोंग-खाप	स्वरांश
probability	ᱥᱚᱢᱵᱷᱟᱹᱣᱱᱟ	सोम्भाव्ना	प्रायिकता
distribution	ᱵᱟᱹᱴᱩᱣᱟᱨᱟ	बाटुआरा	वितरण
random	ᱮᱛ-ᱞᱟᱜᱟ	एत-लागा	यादृच्छिक
variable	ᱵᱚᱫᱚᱞᱚᱜ	बोदोलोग	चर
expectation	ᱠᱟᱹᱴᱤᱫ	काटिद	प्रत्याशा
variance	ᱢᱤᱞ-ᱢᱮᱫ	मिल-मेद	प्रसरण
stochastic	ᱨᱟᱨᱟ-ᱠᱟᱹᱢᱤ	रारा-काम	प्रायिक
markov	ᱢᱟᱨᱠᱚᱣ	मरकोव	मार्कोव
hidden	ᱜᱩᱯᱛᱟ	गुप्ता	छिपा
state	ᱚᱵᱚᱥᱛᱟ	ओबोस्ता	अवस्था
transition	ᱥᱟᱢᱟᱧᱡᱚᱜ	सामञ्जोग	संक्रमण
chain	ᱥᱤᱠᱥᱤᱞᱤ	सिक्सिलि	श्रृंखला
viterbi	ᱣᱤᱴᱟᱨᱵᱤ	विटार्बि	विटर्बी
gaussian	ᱜᱟᱣᱥᱤᱭᱟᱹᱱ	गावसियान	गाउसियन
mixture	ᱢᱤᱥᱟᱹ-ᱞᱟᱹᱭ	मिस्सा-लाय	मिश्रण
accuracy	ᱥᱚᱛ-ᱠᱚᱛ	सोत-कोत	शुद्धता
error	ᱵᱷᱩᱞ	भुल	त्रुटि
rate_error	ᱵᱷᱩᱞ-ᱦᱟᱨ	भुल-हर	त्रुटि-दर
word_error	ᱟᱲᱟ-ᱵᱷᱩᱞ	आड़ा-भुल	शब्द-त्रुटि
mel_cepstral_distortion	ᱢᱮᱞ-ᱥᱮᱯᱴᱨᱚᱢ-ᱵᱤᱜᱟᱲ	मेल-सेप्त्रोम-बिगाड़	एमसीडी
equal_error	ᱥᱟᱢᱟᱱ-ᱵᱷᱩᱞ	समान-भुल	समान-त्रुटि
baseline	ᱢᱩᱞ-ᱥᱟᱞᱟ	मूल-साला	आधार-रेखा
lecture	ᱥᱤᱠᱷᱟ	सिख	व्याख्यान
student	ᱥᱤᱠᱷᱟᱣᱟᱹ	सिखावा	छात्र
teacher	ᱜᱩᱨᱩ	गुरु	शिक्षक
example	ᱪᱤᱠᱷᱤ	चिखि	उदाहरण
problem	ᱡᱟᱦᱟᱱ	जाहान	समस्या
solution	ᱥᱟᱞᱟ	साला	समाधान
equation	ᱥᱤᱢᱤᱠᱟᱨᱚᱱ	सिमिकरण	समीकरण
theorem	ᱥᱤᱫᱷᱟᱱᱛ	सिद्धान्त	प्रमेय
proof	ᱯᱨᱚᱢᱟᱹᱱ	प्रमान	प्रमाण
assignment	ᱠᱟᱢᱤᱤ	कामिइ	असाइनमेंट
exam	ᱯᱚᱨᱥᱚ-ᱫᱤᱱ	पोर्सो-दिन	परीक्षा
"""

# One sentence a line.
LECTURE_SENTENCES = """\
this lecture introduces stochastic processes and their role in speech modelling
the cepstrum is the inverse Fourier transform of the log magnitude spectrum
mel frequency cepstral coefficients are derived from the mel filter bank
hidden Markov models assume a Markov chain of latent states emitting observations
dynamic time warping aligns two sequences of different lengths
the Viterbi algorithm finds the most likely state sequence
formants are resonances of the vocal tract
pitch detection uses autocorrelation or cepstral peak picking
phoneme recognition is the first stage of many speech recognisers
language identification distinguishes between English and Hindi
code switching refers to alternation between two languages within an utterance
connectionist temporal classification trains acoustic models without alignment
attention based encoder decoder architectures dominate modern recognition
transformer models use multi head self attention
word error rate measures substitution insertion and deletion errors
mel cepstral distortion evaluates synthesised speech quality
equal error rate is where false acceptance and false rejection cross
fundamental frequency is the rate of vocal fold vibration
short time Fourier transform gives a time frequency representation
spectral subtraction reduces additive background noise
Wiener filtering uses knowledge of signal and noise power spectra
overlap add synthesis reconstructs the waveform from frames
griffin lim iterative phase reconstruction is used when phase is missing
vocoders convert acoustic features to waveforms
WaveNet is an autoregressive neural vocoder
HiFi GAN is a generative adversarial vocoder
VITS end to end architecture combines flows and adversarial training
YourTTS supports zero shot multilingual voice cloning
speaker embedding captures speaker identity in a compact vector
x vectors are statistics pooling embeddings from TDNN
d vectors are utterance embeddings from a speaker classifier
prosody includes rhythm stress and intonation
G2P converts graphemes to phonemes using rules or neural models
IPA is the international phonetic alphabet
low resource languages lack parallel corpora and pronunciation lexicons
transfer learning adapts models trained on high resource data
self supervised learning exploits unlabelled audio
wav2vec 2 learns representations via contrastive prediction
Whisper is a robust multilingual ASR model
constrained beam search restricts hypotheses to allowed tokens
logit biasing adds scalar offsets to chosen vocabulary items
FGSM is the fast gradient sign method for adversarial attacks
anti spoofing detects synthesised or replayed speech
LFCC are linear frequency cepstral coefficients
CQCC uses the constant Q transform for anti spoofing
the Mel scale approximates human auditory frequency resolution
pre emphasis flattens the spectral tilt of voiced speech
windowing reduces spectral leakage
the short time energy measures frame level loudness
pitch contours carry prosodic information
f zero estimation is critical for prosody warping
Hinglish mixes English and Hindi within a single utterance
teachers often switch to Hindi for explanations and English for technical terms
the syllabus covers acoustic phonetics and digital signal processing
mid term projects require a pipeline from feature extraction to synthesis
anti aliasing filtering precedes down sampling
Nyquist theorem bounds the maximum representable frequency
linear predictive coding models the vocal tract as an all pole filter
filter bank energies are robust features
maximum likelihood estimation fits parameters to data
Bayesian inference computes posterior distributions
EM algorithm iteratively optimises latent variable models
Gaussian mixture models represent density as a weighted sum of Gaussians
i vector is a low dimensional speaker factor representation
zero shot cloning generates speech in an unseen speaker voice
the final lecture covers evaluation metrics WER MCD and EER
adversarial robustness measures perturbation epsilon for misclassification
semantic translation preserves meaning across languages
Indian languages include Hindi Bengali Tamil Telugu Santhali Maithili
acoustic model and language model scores are combined in decoding
kaldi wav2vec2 and whisper are common ASR toolkits
evaluation on a held out test set avoids overfitting
regularisation prevents overfitting through dropout or weight decay
"""
