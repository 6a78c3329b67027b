"""Built-in file types.

Fixed values: a type's extensions (with the dot), file names, and first-line
patterns (between slashes).
"""

BUILTIN = {
    "actionscript": ".as .mxml",
    "ada": ".ada .adb .ads",
    "asm": ".asm .s .S",
    "asp": ".asp",
    "aspx": ".master .ascx .asmx .aspx .svc",
    "autoconf": ".ac .in",
    "automake": ".am .in",
    "awk": ".awk",
    "batch": ".bat .cmd",
    "cc": ".c .h .xs",
    "cfmx": ".cfc .cfm .cfml",
    "clojure": ".clj",
    "cmake": "CMakeLists.txt .cmake",
    "coffeescript": ".coffee",
    "cpp": ".cpp .cc .cxx .m .hpp .hh .h .hxx",
    "csharp": ".cs",
    "css": ".css",
    "dart": ".dart",
    "delphi": ".pas .int .dfm .nfm .dof .dpk .dproj .groupproj .bdsgroup .bdsproj",
    "elisp": ".el",
    "elixir": ".ex .exs",
    "erlang": ".erl .hrl",
    "fortran": ".f .f77 .f90 .f95 .f03 .for .ftn .fpp",
    "go": ".go",
    "groovy": ".groovy .gtmpl .gpp .grunit .gradle",
    "haskell": ".hs .lhs",
    "hh": ".h",
    "html": ".htm .html",
    "jade": ".jade",
    "java": ".java .properties",
    "js": ".js",
    "json": ".json",
    "jsp": ".jsp .jspx .jhtm .jhtml",
    "less": ".less",
    "lisp": ".lisp .lsp",
    "lua": r".lua /^#!.*\blua(jit)?/",
    "m4": ".m4",
    "make": ".mk .mak makefile Makefile Makefile.Debug Makefile.Release",
    "matlab": ".m",
    "miscellaneous": ".qbk .w .ipp .patch configure",
    "objc": ".m .h",
    "objcpp": ".mm .h",
    "ocaml": ".ml .mli",
    "parrot": ".pir .pasm .pmc .ops .pod .pg .tg",
    "perl": r".pl .pm .pod .t .psgi /^#!.*\bperl/",
    "perltest": ".t",
    "php": r".php .phpt .php3 .php4 .php5 .phtml /^#!.*\bphp/",
    "plone": ".pt .cpt .metadata .cpy .py",
    "python": r".py /^#!.*\bpython/",
    "rake": "Rakefile",
    "rr": ".R",
    "rst": ".rst",
    "ruby": r".rb .rhtml .rjs .rxml .erb .rake .spec Rakefile /^#!.*\bruby/",
    "rust": ".rs",
    "sass": ".sass .scss",
    "scala": ".scala",
    "scheme": ".scm .ss",
    "shell": r".sh .bash .csh .tcsh .ksh .zsh .fish /^#!.*\b(?:ba|t?c|k|z|fi)?sh\b/",
    "smalltalk": ".st",
    "smarty": ".tpl",
    "sql": ".sql .ctl",
    "stylus": ".styl",
    "tcl": ".tcl .itcl .itk",
    "tex": ".tex .cls .sty",
    "text": ".txt ChangeLog README",
    "tt": ".tt .tt2 .ttml",
    "vb": ".bas .cls .frm .ctl .vb .resx",
    "verilog": ".v .vh .sv",
    "vhdl": ".vhd .vhdl",
    "vim": ".vim",
    "xml": ".xml .dtd .xsl .xslt .ent /<[?]xml/",
    "yaml": ".yaml .yml",
}

#: Directories that are never entered unless they are named as a start.
EXCLUDED_DIRS = (".bzr", ".git", ".hg", ".metadata", ".svn", "CMakeFiles", "CVS", "autom4te.cache", ".deps")
