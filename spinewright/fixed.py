"""Names, tables and patterns that the results depend on."""

# File extensions of audio, in the order of the specification.
EXTENSIONS = ("mp3", "m4a", "m4b", "m4p", "flac", "ogg", "opus", "aac", "wav", "wma", "mp4", "aiff", "ape")

# How much a format is preferred.
FORMAT_SCORE = {"m4b": 4, "m4a": 3, "mp4": 3, "flac": 2, "opus": 2, "ogg": 1, "mp3": 1, "aac": 1, "wma": 0, "wav": 0, "aiff": 0, "ape": 0, "m4p": 3}

# Letters that don't decompose, and what they become.
LETTERS = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss"}

# Patterns of names and titles.
ROLES = r"\s*[-–—]\s*(?:introductions?|narrator|translator|foreword|adaptation|editor)s?\b[^,;]*"
CATALOGUE_ID = r"\s*\[[A-Z0-9]{10,}\]"
NUMERIC_ID = r"\s*\[\d{10,}\]"
PARENTHESES = r"\s*\([^)]*\)"
VOLUME = r"\b(?:series|part|act|volume|book|books|vol|no|disc|disk|cd)\s+(?:\d+|[ivx]+|[a-z])"
TRACK_PREFIX = r"^(?:(?:D\d{2}-T\d{2}|\d{2})\s*-\s*)+"
COPY_SUFFIX = r"\.\d+(?=\.[^.]+$)"

# Fallback names, and the longest component of a path.
UNKNOWN_AUTHOR, UNKNOWN_BOOK, COMPONENT_LENGTH = "_Unknown Author", "_Unknown Book", 180

# Characters that a path may not hold, and what stands for them; empty: removed.
PATH_CHARACTERS = {"/": "∕", "\\": "∕", ":": "∶", "*": "∗", "?": "", '"': "", "<": "‹", ">": "›", "|": "│", "\t": " "}

# Folders that only hold what isn't sorted yet.
PLACEHOLDERS = ("_unknown author", "_unknown", "unknown", "unknown author", "audiobooks", "classics & general fiction")

# The tags that give each field, by priority.
TAG_CHAINS = {
    "author": ("album_artist", "albumartist", "album artist", "tpe2", "artist", "tpe1", "composer", "tcom", "narrator", "txxx:narrator", "txxx:narrated_by", "sort_artist", "artistsort", "tso2"),
    "book": ("album", "talb", "work", "©wrk", "txxx:work", "tvshow"),
    "title": ("title", "tit2", "©nam"),
    "track": ("track", "trck", "trkn"),
    "disc": ("disc", "tpos", "disk", "disknumber"),
    "series": ("txxx:series", "series", "txxx:series_name", "series_name", "txxx:seriesname", "grouping", "tit1", "work", "©wrk"),
    "series_index": ("txxx:series-part", "txxx:series_part", "txxx:seriespart", "series-part", "series_part", "seriespart", "movementnumber", "©mvi", "movement"),
    "narrator": ("narrator", "txxx:narrator", "txxx:narrated_by", "composer", "tcom"),
    "year": ("date", "tdrc", "year", "©day", "tyer"),
    "subtitle": ("subtitle", "txxx:subtitle", "tit3"),
    "genre": ("genre", "tcon", "©gen"),
}

# Atoms of MP4 files and the tags that they stand for.
MP4_ATOMS = {
    "©ART": "artist", "©art": "artist", "aART": "album_artist", "aart": "album_artist", "©alb": "album", "©nam": "title", "©wrt": "composer", "©grp": "grouping", "©day": "date",
    "©gen": "genre", "©wrk": "work", "©mvn": "movement_name", "©mvi": "movementnumber", "trkn": "trkn", "disk": "disk", "soar": "sort_artist", "soal": "sort_album",
}

# Attributes of ASF files and the tags that they stand for.
ASF_ATTRIBUTES = {
    "author": "artist", "title": "title", "wm/albumtitle": "album", "wm/albumartist": "album_artist", "wm/year": "date", "wm/genre": "genre",
    "wm/tracknumber": "track", "wm/track": "track", "wm/composer": "composer", "wm/subtitle": "subtitle", "wm/partofset": "disc",
}

#: Bytes of a file's head that its fingerprint covers.
FINGERPRINT_BYTES = 1_048_576
#: Seconds by which lengths of one recording may differ.
TOLERANCE = 1.0
