"""Values fixed by the data format. They have to stay as they are for results to match."""

# fixed values: palette
BLANK = "~"
PALETTE_START = 59          # code point of the darkest colour
PALETTE_LEVELS = 4          # levels per channel
BLANK_ABOVE = 245           # every channel above: blank
BLANK_BELOW = 10            # every channel below: blank

# fixed values: special tokens, in id order
PAD, BOS, EOS, UNK = "[PAD]", "[BOS]", "[EOS]", "[UNK]"
N_ROWS = 64
ROW_PREFIX = "[ROW_"
ROW_TOKENS = [f"[ROW_{i:02d}]" for i in range(N_ROWS)]
SPECIAL_TOKENS = [PAD, BOS, EOS, UNK] + ROW_TOKENS
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
FIRST_ROW_ID = 4

# fixed values: sequence layout
GRID_SIZE = 64
ROW_LENGTH = 64             # one marker and 63 pixels
CONTEXT_LENGTH = N_ROWS * ROW_LENGTH
POSITION_PAD = 64           # row or column id of everything that is not in a row
TEXT_PREFIX = 512
ROW_START = "00"            # row start in the older sequence text

# fixed values: filters and weights
DOMINANCE_THRESHOLD = 0.95
BACKGROUND_WEIGHT = 0.6
GENERATIONS = ["gen1", "gen2", "gen3", "gen4"]
DEFAULT_GENERATIONS = ["gen3", "gen4"]

# fixed values: channel permutations; entry i is the source channel (r, g, b) of channel i
PERMUTATIONS = [
    ("_rg", (1, 0, 2)),
    ("_rb", (2, 1, 0)),
    ("_gb", (0, 2, 1)),
    ("_cyc1", (1, 2, 0)),
    ("_cyc2", (2, 0, 1)),
]
FLIP_SUFFIX = "_flip"

# fixed values: names
NAME_CHARS = 16
IDENTITY_SUFFIXES = [r"(_frame2)?_flip$", r"_frame2$", r"_(rg|rb|gb|cyc1|cyc2)$"]
NAME_CHARS_SUFFIX = r"(_shiny)?(_female)?(_frame2)?(_flip)?\.txt$"

# fixed values: enumerations, in code order
TYPES = [
    "normal", "fire", "water", "electric", "grass", "ice", "fighting", "poison", "ground",
    "flying", "psychic", "bug", "rock", "ghost", "dragon", "dark", "steel", "fairy",
]
COLORS = ["red", "blue", "yellow", "green", "black", "brown", "purple", "gray", "white", "pink"]
SHAPES = [
    "ball", "squiggle", "fish", "arms", "blob", "upright", "legs", "quadruped", "wings",
    "tentacles", "heads", "humanoid", "bug-wings", "armor",
]
HABITATS = [
    "cave", "forest", "grassland", "mountain", "rare", "rough-terrain", "sea", "urban",
    "waters-edge",
]
TYPE1_UNKNOWN = 18
TYPE2_NONE = 18
COLOR_UNKNOWN = 10
SHAPE_UNKNOWN = 14
HABITAT_NONE = 9
LAST_STAGE_CODE = 3
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9}

# fixed values: sizes of the fields a sampled condition is drawn from
FIELD_RANGES = {
    "type1": 19, "type2": 20, "is_shiny": 2, "generation": 10,
    "evolution_stage": 4, "has_evolution": 2, "color_shift": 6,
}

# fixed values: log blocks
LOG_END = "=" * 36
LOG_OPEN_HEADER = r"(=== Inference @ step \d+ ===)\r?\z"
LOG_PATTERN = r"(?s)=== Inference @ step (\d+) ===\n(.*?)\n" + LOG_END

# whitespace other than the blank, and line breaks, as str.split and str.splitlines see them
OTHER_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = rf"\r\n|[{LINE_BREAKS}]"

# size bound of everything that is collected to be sent to the tasks
MAX_BROADCAST_ROWS = 65_536
