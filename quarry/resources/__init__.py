"""The names by which calls to builtins and standard libraries are told."""

from __future__ import annotations

import builtins
import sys

# Modules of Node's standard library.
NODE_MODULES = (
    "assert", "buffer", "child_process", "cluster", "console", "crypto", "dgram", "diagnostics_channel", "dns", "dns/promises",
    "domain", "events", "fs", "fs/promises", "http", "http2", "https", "inspector", "module", "net", "os", "path", "path/posix",
    "path/win32", "perf_hooks", "punycode", "querystring", "readline", "readline/promises", "repl", "stream", "stream/consumers",
    "stream/promises", "stream/web", "string_decoder", "timers", "timers/promises", "tls", "tty", "url", "util", "util/types",
    "v8", "vm", "wasi", "worker_threads", "zlib",
)
JS_OBJECTS = (
    "console", "Math", "JSON", "Number", "String", "Object", "Array", "Promise", "Date", "RegExp", "Map", "Set", "WeakMap",
    "WeakSet", "Symbol", "BigInt", "Reflect", "Intl", "URL", "URLSearchParams", "TextEncoder", "TextDecoder", "Buffer",
    "process", "document", "window", "globalThis",
)
JS_FUNCTIONS = (
    "setTimeout", "clearTimeout", "setInterval", "clearInterval", "setImmediate", "clearImmediate", "queueMicrotask", "fetch",
    "atob", "btoa", "requestAnimationFrame", "cancelAnimationFrame", "parseInt", "parseFloat", "isNaN", "isFinite",
    "encodeURI", "encodeURIComponent", "decodeURI", "decodeURIComponent",
)
GO_BUILTINS = (
    "append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic",
    "print", "println", "real", "recover",
)
# Java packages, each with all below it.
JAVA_PACKAGES = ("java", "javax", "jdk", "sun", "com.sun", "javafx", "org.w3c", "org.xml")
JAVA_CLASSES = (
    "System", "String", "Math", "Integer", "Long", "Double", "Float", "Boolean", "Character", "Object", "Class", "Thread",
    "Runtime", "Process", "ProcessBuilder", "Exception", "RuntimeException", "Error", "Throwable", "Enum", "StringBuilder",
    "StringBuffer",
)
RUST_CRATES = ("std", "core", "alloc")
RUST_FUNCTIONS = ("drop",)
C_HEADERS = (
    "assert.h", "ctype.h", "errno.h", "float.h", "limits.h", "locale.h", "math.h", "setjmp.h", "signal.h", "stdarg.h",
    "stddef.h", "stdint.h", "stdio.h", "stdlib.h", "string.h", "time.h", "wchar.h", "wctype.h", "cstdio", "cstdlib", "cstring",
    "cmath", "cassert", "iostream", "vector", "string", "map", "unordered_map", "set", "unordered_set", "memory", "utility",
    "algorithm", "functional", "thread", "mutex", "chrono", "bits/stdc++.h",
)
CPP_FUNCTIONS = (
    "sort", "swap", "move", "forward", "make_pair", "make_tuple", "make_shared", "make_unique", "to_string", "stoi", "stol",
    "stoll", "stof", "stod", "stold",
)
C_FUNCTIONS = (
    "assert", "abort", "exit", "perror", "printf", "fprintf", "sprintf", "snprintf", "scanf", "fscanf", "sscanf", "puts",
    "fputs", "putchar", "getchar", "fopen", "fclose", "fread", "fwrite", "fflush", "fseek", "ftell", "fgets", "malloc",
    "calloc", "realloc", "free", "memcpy", "memmove", "memset", "memcmp", "strlen", "strcpy", "strncpy", "strcat", "strncat",
    "strcmp", "strncmp", "strchr", "strrchr", "strstr", "strtok", "tolower", "toupper", "isalnum", "isalpha", "isdigit",
    "isspace",
)
# Python's own lists: the interpreter's names, with those of modules it no longer has and without those that are
# not counted, so that they do not depend on its version.
PYTHON_RETIRED = (
    "_msi", "_sha256", "_sha512", "aifc", "asynchat", "asyncore", "audioop", "cgi", "cgitb", "chunk", "crypt", "distutils",
    "imghdr", "imp", "lib2to3", "mailcap", "msilib", "nis", "nntplib", "pipes", "smtpd", "sndhdr", "sunau", "telnetlib",
)
PYTHON_UNCOUNTED = (
    "_aix_support", "_android_support", "_asyncio", "_codecs_cn", "_codecs_hk", "_codecs_iso2022", "_codecs_jp", "_codecs_kr",
    "_codecs_tw", "_colorize", "_curses_panel", "_dbm", "_frozen_importlib", "_frozen_importlib_external", "_gdbm",
    "_interpchannels", "_interpqueues", "_interpreters", "_ios_support", "_lsprof", "_opcode_metadata", "_overlapped",
    "_posixsubprocess", "_pydatetime", "_pylong", "_pyrepl", "_scproxy", "_sha2", "_sitebuiltins", "_sre", "_strptime",
    "_suggestions", "_symtable", "_sysconfig", "_tokenize", "_winapi", "_wmi", "_zoneinfo", "genericpath", "grp", "idlelib",
    "nt", "ntpath", "nturl2path", "opcode", "posixpath", "pydoc_data", "pyexpat", "sre_compile", "sre_constants", "sre_parse",
    "syslog", "termios", "this", "tomllib", "turtledemo", "zoneinfo",
)
BUILTINS_UNCOUNTED = ("Ellipsis", "False", "None", "PythonFinalizationError", "True", "_IncompleteInputError", "copyright", "credits", "exit", "license", "quit")
PYTHON_BUILTINS = tuple(sorted((set(dir(builtins)) | {"__build_class__", "__debug__", "help"}) - set(BUILTINS_UNCOUNTED)))
PYTHON_MODULES = tuple(sorted((set(sys.stdlib_module_names) | set(PYTHON_RETIRED)) - set(PYTHON_UNCOUNTED)))
