"""Fixed values that results must reproduce exactly.

Every function that uses one of these takes it as a parameter with the value
below as its default.
"""

# --- fixed values: workload parameters ------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
TOP_K = 3
CONTENT_CAP = 100_000          # content prompt cap, notice appended
BRAIN_CAP = 80_000             # brain prompt cap, no notice
SFT_SUMMARY_MIN = 50           # paragraph length must be > this
SFT_TOPIC_MIN = 100            # paragraph length must be > this
SFT_SENTENCE_MIN = 20          # sentence length must be > this
SFT_INPUT_CUT = 500
SFT_TOPIC_CUT = 100
SFT_MIN_SAMPLES = 5
CORPUS_MIN_CHARS = 500
BLOCK_SIZE = 128
BLOCK_STRIDE = 64
MIN_BLOCKS = 5
VOCAB_SIZE = 5000
MIN_PAIR_FREQUENCY = 2
PREVIEW_LEN = 50
PARAGRAPH_SEP = "\n\n"
SPECIAL_TOKENS = ["<pad>", "<unk>", "<bos>", "<eos>"]

# --- fixed values: texts --------------------------------------------------
CAP_NOTICE = "\n\n[NOT: Metin çok uzun olduğu için kısaltıldı]"
CONTENT_PROMPT_TEMPLATE = (
    "Sen özelleştirilmiş bir yapay zeka asistanısın.\n"
    "Aşağıdaki bilgiler senin temel bilgi kaynağındır:\n"
    "\n"
    "{CONTENT}\n"
    "\n"
    "Kullanıcı sorularını bu bilgilere dayanarak cevapla.\n"
    "Eğer bilgi dışında bir şey sorulursa, genel bilgini kullan ama bunu belirt."
)
CONTENT_PLACEHOLDER = "{CONTENT}"
BRAIN_HEADER = "\n\n--- EK BİLGİ KAYNAĞI ---\n\n"
RAG_SYSTEM_TEMPLATE = (
    "Sen bir asistansın. Aşağıdaki bilgilere dayanarak cevap ver:\n"
    "\n"
    "{CONTEXT}\n"
    "\n"
    "Eğer soruyu bu bilgilerle cevaplayamazsan, bunu söyle."
)
PLAIN_SYSTEM_PROMPT = "Sen yardımcı bir asistansın."
SOURCES_PREFIX = "\n\n📚 Kaynaklar: "
STOP_NOTICE = "\n\n⏹ *[Yanıt durduruldu]*"
ERROR_PREFIX = "❌ Hata: "
SFT_SUMMARY_INSTRUCTION = "Aşağıdaki bilgiyi özetle ve açıkla:"
SFT_TOPIC_PREFIX = "Bu konuda bilgi ver: "
SFT_TEMPLATE = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"
DEFAULT_MODEL_NAME = "genel"
UNKNOWN_MODEL_NAME = "bilinmeyen"
MISSING_SOURCE = "?"

# --- fixed values: progress percentages ------------------------------------
PROGRESS_SCRATCH = (0.45, 0.45)    # base, span
PROGRESS_FINETUNE = (0.6, 0.35)
PROGRESS_LOADING = (0.1, 0.3)

# --- fixed values: file formats --------------------------------------------
# lower-cased extension -> reader name; anything else is unsupported.
FORMAT_BY_EXTENSION = {
    ".txt": "text",
    ".pdf": "pdf",
    ".docx": "docx",
    ".doc": "docx",
    ".xlsx": "excel",
    ".xls": "excel",
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "json",
}

# Python's str.isspace() characters (what str.strip() removes).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
