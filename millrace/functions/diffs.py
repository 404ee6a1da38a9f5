"""Functions on unified diffs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# File suffixes that are not code.
NON_CODE = [
    ".md", ".mdx", ".markdown", ".txt", ".rst", ".adoc", ".html", ".css", ".svg", ".xml", ".json", ".yaml", ".yml", ".csv", ".ini", ".cfg", ".toml", ".lock", ".gitignore", ".geojson",
    ".properties", ".conf", ".config", ".env", ".options", ".local", ".production", ".development", ".csproj", ".vbproj", ".fsproj", ".vcxproj", ".classpath", ".pom", ".project",
    ".factories", ".template", ".in", ".am", ".sum", ".mod", ".ci", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".graffle", ".zip", ".gz", ".tar", ".jar", ".war", ".ear", ".aar", ".snap",
    ".so", ".dll", ".exe", ".bin", ".dylib", ".class", ".o", ".obj", ".out", ".db", ".sqlite", ".sqlite3", ".avro", ".parquet", ".data", ".index", ".snapshot", ".jks", ".p12", ".pem",
    ".crt", ".key", ".pub", ".sha1", ".xls", ".xlsx", ".pdf", ".xsd", ".xsl", ".pbxproj", ".xcscheme", ".jmx", ".android_arm64", ".android_armv7", ".arm64", ".armv6", ".armv7",
    ".amzn_linux_cpu", ".ubuntu", ".ubuntu1404_cuda75_cudnn5", ".jetson", ".ubuntu_cpu", ".ubuntu_gpu", ".ubuntu_build_cuda", ".agentpluginbootservice", ".baseflinksource", ".basesink",
    ".basesource", ".basetransform", ".basestructuredstreaminginput", ".basestructuredstreamingoutput", ".basestructuredstreamingoutputintra", ".basecommand", ".datasourcemapconverter",
    ".databasediscoverytype", ".dispatcher", ".handlers", ".java17", ".mlformatregister", ".mockmaker", ".pmml", ".privilegeloader", ".privilegeloadalgorithm", ".protobufserde", ".provides",
    ".rpcfilter", ".schemas", ".shardingtransactionhandler", ".timeservice", ".transactionmanager", ".transformer", ".yamlruleconfigurationswapper", ".part", ".9-snapshot", ".12-snapshot",
    ".16-snapshot", ".6-global-window-serializer-data", ".6-global-window-serializer-snapshot", ".6-time-window-serializer-data", ".6-time-window-serializer-snapshot",
    ".7-global-window-serializer-data", ".7-global-window-serializer-snapshot", ".7-time-window-serializer-data", ".7-time-window-serializer-snapshot", ".1", ".2", ".3", ".4", ".5", ".6",
    ".7", ".8", ".9", ".explain", ".commands", ".factory", ".tdd", ".base", ".jenkinsfile", ".rules", ".tmpl",
]
# Languages by suffix.
LANGUAGES = {
    ".py": "Python", ".java": "Java", ".scala": "Scala", ".kt": "Kotlin", ".groovy": "Groovy", ".js": "JavaScript", ".ts": "TypeScript",
    ".jsx": "JavaScript (JSX)", ".tsx": "TypeScript (TSX)", ".c": "C", ".h": "C/C++ Header", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++ Header",
    ".cs": "C#", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".r": "R", ".m": "Objective-C / MATLAB", ".sh": "Shell", ".bash": "Bash",
    ".zsh": "Zsh", ".ps1": "PowerShell", ".sql": "SQL", ".lua": "Lua", ".pl": "Perl", ".ex": "Elixir", ".exs": "Elixir Script", ".erl": "Erlang", ".hrl": "Erlang",
    ".hs": "Haskell", ".clj": "Clojure", ".proto": "Protobuf", ".thrift": "Thrift",
}
# Marks around a diff in a prompt, and the mark of a cut.
START, END, CUT = "--- START OF CODE DIFF ---", "--- END OF CODE DIFF ---", "\n... [diff truncated]"

#: From a header to the next; the first kind names the file after the first " b/", the second after the last.
HEADER, HEADER_LAST = r"^diff --git a/.* b/.*$", r"^diff --git a/.+ b/.+$"


def split_diff(diff: Column) -> Column:
    """array<struct<file, chunk>> of the files of a diff; text before the first header is left out; a file is what follows the header's first " b/"."""
    chunks = F.filter(F.split(diff, f"(?dm)(?={HEADER})"), lambda c: F.regexp_like(c, F.lit(f"(?dm)\\A{HEADER}")))
    return F.transform(chunks, lambda c: F.struct(strip(F.regexp_extract(F.substring_index(c, "\n", 1), r"(?d) b/(.+)$", 1)).alias("file"), c.alias("chunk")))


def split_diff_last(diff: Column) -> Column:
    """As split_diff, but a file is what follows the header's last " b/", and chunks are stripped."""
    chunks = F.filter(F.split(diff, f"(?dm)(?={HEADER_LAST})"), lambda c: F.regexp_like(c, F.lit(f"(?dm)\\A{HEADER_LAST}")))
    return F.transform(chunks, lambda c: F.struct(strip(F.regexp_extract(c, r"(?dm)\Adiff --git a/.+ b/(.+)$", 1)).alias("file"), strip(c).alias("chunk")))


def suffix(path: Column) -> Column:
    """Suffix of the last part of a path, in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))


def plain_extension(path: Column) -> Column:
    """After the last dot of the whole path, unless it begins with one."""
    return F.when(F.contains(path, F.lit(".")) & ~F.startswith(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("no_extension")


def lower_extension(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def is_code(path: Column, non_code: list[str] | None = None) -> Column:
    return ~suffix(path).isin(list(non_code or NON_CODE))


def code_part(diff: Column) -> Column:
    """The diff without files that are not code."""
    return strip(F.array_join(F.transform(F.filter(split_diff(diff), lambda f: is_code(f["file"])), lambda f: f["chunk"]), ""))


def length_by_file(diff: Column) -> Column:
    """map<file, length of its chunk>; of a file's chunks the last counts."""
    sizes = F.array_sort(F.transform(split_diff(diff), lambda f, i: F.struct(f["file"].alias("file"), i.alias("at"), F.length(f["chunk"]).cast("long").alias("size"))))
    # Of neighbours in this order the last of a file stays. The list of one list gives it a name, so that it is made once.
    lasts = lambda parts: F.filter(parts, lambda f, i: ~f["file"].eqNullSafe(F.get(parts, i + 1)["file"]))
    return F.map_from_entries(F.transform(F.get(F.transform(F.array(sizes), lasts), F.lit(0)), lambda f: F.struct(f["file"], f["size"])))


def code_files(files: Column) -> Column:
    return F.filter(files, lambda p: is_code(p))


def languages(files: Column) -> Column:
    """Distinct sorted languages of the code files; a suffix without one stands for itself, none for unknown."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])

    def one(p: Column) -> Column:
        s = suffix(p)
        return F.when(s == "", "unknown").otherwise(F.coalesce(F.try_element_at(names, s), s))

    return F.array_sort(F.array_distinct(F.transform(code_files(files), one)))


def excluded_suffixes(files: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(files, lambda p: ~is_code(p)), suffix)))


def _lines_with(diff: Column, sign: str) -> Column:
    """Lines that begin with a sign, but not with three of it. Counted by what is left without the signs, since a pattern would be tried at each character."""
    lines = F.concat(F.lit("\n"), diff)
    without = lambda mark: F.octet_length(F.replace(lines, F.lit(mark), F.lit("")))
    one, three = "\n" + sign, "\n" + 3 * sign
    every, headers = (F.octet_length(lines) - without(one)) / len(one), (F.octet_length(lines) - without(three)) / len(three)
    return (every - headers).cast("long")


def added_lines(diff: Column) -> Column:
    return _lines_with(diff, "+")


def deleted_lines(diff: Column) -> Column:
    return _lines_with(diff, "-")


def between_marks(text: Column) -> Column:
    """What stands between the marks, stripped; null if one is missing or they are the wrong way round."""
    a, b = F.locate(START, text), F.locate(END, text)
    return F.when((a > 0) & (b > a), strip(F.substring(text, a + len(START), b - a - len(START))))


def file_diffs(messages: Column) -> Column:
    """array<struct<file, chunk>> of the first user message; all of it where marks are missing, one unnamed file where headers are."""
    said = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    diff = F.coalesce(between_marks(said), said)
    parts = split_diff_last(diff)
    whole = F.array(F.struct(F.lit("(full diff)").alias("file"), diff.alias("chunk")))
    return F.when(said.isNull(), F.slice(whole, 1, 0)).when(F.size(parts) == 0, whole).otherwise(parts)


def cut_at_line(text: Column, cap: int) -> Column:
    """At most `cap` characters, up to the last line end among them, with a mark; shorter texts as they are."""
    head = F.substring(text, 1, cap)
    back = F.locate("\n", F.reverse(head))
    kept = F.when(back > 0, F.substring(text, F.lit(1), cap - back)).otherwise(head)
    return F.when(F.length(text) > cap, F.concat(kept, F.lit(CUT))).otherwise(text)


def cut_tokens(words: Column, cap: int) -> Column:
    return F.array_join(F.slice(words, 1, cap), " ")
