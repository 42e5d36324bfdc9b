"""Fixed values that results depend on."""

# Character classes, in Java's notation.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
TRANSLATABLE = rf"[A-Za-z\x{{00C0}}-\x{{024F}}{CJK}]"
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NAME_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"

# Spans that are protected, in the order in which they are taken.
INLINE = (
    ("code", r"``[^`]+``|`[^`\n]+`"),
    ("math", r"\$\$[^$]+\$\$|\$[^$\n]+\$"),
    ("linkdest", rf'(?<=\])\([^){WHITE}]+(?:[{WHITE}]+"[^"]*")?\)'),
    ("refdest", r"(?<=\])\[[^\]]*\]"),
    ("autolink", rf"<https?://[^>{WHITE}]+>|<[a-zA-Z0-9._%+-]+@[^>{WHITE}]+>"),
    ("url", rf"https?://[^{WHITE})\]<>]+"),
    ("footnote", r"\[\^[^\]]+\]"),
    ("htmltag", rf"</?[A-Za-z][A-Za-z0-9-]*(?:[{WHITE}][^<>]*)?/?>"),
    ("var", r"\{\{[^}]*\}\}|\$\{[^}]*\}|\{[A-Za-z0-9_.]*\}|%\([A-Za-z0-9_]+\)[sd]|%[sd]"),
    ("entity", r"&[a-zA-Z]+;|&#\p{Nd}+;"),
)
# What every such span but a URL has somewhere.
INLINE_SIGNS = r"[`$<{%&\[\]]"
MANGLED = rf"[⟦【〔〚\[]{{1,2}}[{WHITE}]*([0-9０-９]+)[{WHITE}]*[⟧】〕〛\]]{{1,2}}"

# Half-width marks and their full-width forms; what counts as full-width punctuation.
HALF_TO_FULL = ((",", "，"), (";", "；"), (":", "："), ("!", "！"), ("?", "？"))
FULLWIDTH = "，。！？；：「」『』（）【】《》、…—"

# Sentence marks.
STRONG, WEAK = "。！？.!?", "…⋯"
CLOSERS, SYMMETRIC = "’”»›」』〉》】〕｝）)]}", "\"'*_~"
CANNOT_START = "，、；：,;:」』〉》】〕｝）)]}"
OPENING = "「『（《〈【〔｛“‘\"'([{"
IN_WORD = "'’-"
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "Mt", "Capt", "Lt", "Sgt", "Col", "Gen", "Rev", "Hon")
STOPWORDS = ("I", "I'm", "I'll", "I've", "I'd")

# Chapter headings of plain text.
CHAPTERS = (
    r"(?:chapter|part|book|volume)\b[\s.:—–-]*(?:\d{1,4}|[ivxlcdm]{1,8}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|first|second|third|last|final)\b.{0,30}$",
    r"(?:prologue|epilogue|interlude|prelude|foreword|preface|afterword|appendix)\b.{0,30}$",
)

# Words of another variety of Chinese: banned form, right form, severity.
LEXICON = (
    ("軟件", "軟體", "error"), ("硬件", "硬體", "error"), ("插件", "外掛/擴充套件", "error"), ("屏幕", "螢幕", "error"),
    ("網絡", "網路", "error"), ("服務器", "伺服器", "error"), ("硬盤", "硬碟", "error"), ("打印", "列印", "error"),
    ("缺省", "預設", "error"), ("賬號", "帳號", "error"), ("線程", "執行緒", "error"), ("緩存", "快取", "error"),
    ("標簽", "標籤", "error"), ("端口", "連接埠", "error"), ("短信", "簡訊", "error"), ("信息", "資訊", "error"),
    ("視頻", "影片", "error"), ("鼠標", "滑鼠", "error"), ("兼容", "相容", "error"), ("內存", "記憶體", "warn"),
    ("激活", "啟用", "warn"), ("集成", "整合", "warn"), ("調試", "除錯", "warn"), ("數組", "陣列", "warn"),
    ("變量", "變數", "warn"), ("帶寬", "頻寬", "warn"), ("復用", "重複使用", "warn"),
)
# A banned form right before one of these characters is part of another word.
LEXICON_UNLESS_BEFORE = {"視頻": "道率寬譜段繁仍", "鼠標": "本", "兼容": "並"}
LENGTH_RATIOS, DEFAULT_RATIO, LENGTH_FLOOR = {"zh-TW": (0.25, 1.2)}, (0.2, 2.5), 40

# Encodings: byte-order marks with their encodings, longest first, and candidates for text without one.
BOMS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
TEXT_ENCODINGS = ("utf-8", "shift_jis", "cp950", "gbk", "cp1252")
EXTENSIONS = {".md": "markdown", ".markdown": "markdown", ".mdown": "markdown", ".mkd": "markdown", ".txt": "text", ".text": "text"}
MARKERS = {"markdown": "<!-- untranslated {id} -->", "text": "[untranslated {id}]"}

# Versions, registers, origins and limits.
SEGMENTATION_VERSION, STATE_VERSION = 1, 3
DEFAULT_TONE, HUMAN, MODEL_PREFIX, HELD = "technical", "human", "llm:", "held"
ALIGN_BUDGET = 8_000_000
BATCH_SIZE, REPAIR_ROUNDS, CONTEXT = 25, 3, 1
STYLE_PREAMBLE_MAX, STYLE_BLOCK_MAX = 2000, 800
