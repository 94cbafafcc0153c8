"""The signatures of the license scan, written by hand: names, identifiers, addresses, headers, clauses and notices.

Patterns are lower case and are matched without regard to the case of ASCII
letters.  Every match of a pattern holds the keyword beside it.  Groups repeat
only possessively or a bounded number of times, so that no match recurses in
step with the text.  In a pattern with a capturing group, what the group took
is appended to the label.
"""

from __future__ import annotations

_V = r"(?:,?\s+(?:version|v\.?)\s*|[\s-]+v?)"
_L = r"licen[cs]e"

#: Words of which a text of most signatures holds one.
STEMS = ["licen", ".org/", "software", "copyright", "permission", "commons", "rights", "public", "gpl", "source", "distribut", "exception", "warrant", "serv", "attribution", "perl", "names", "trade", "confiden", "proprietary", ".eu/", ".com/", ".net", ".dev", "acade"]

#: (label, keyword, name, SPDX identifiers or "", address or "")
FAMILIES = [
    ("apache-2.0", "apache", rf"apache(?:\s+software)?\s+{_L}(?:{_V}2(?:\.0)?)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", rf"apache(?:\s+software)?\s+{_L}{_V}1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", "apache", rf"apache(?:\s+software)?\s+{_L}{_V}1\.0", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    ("mit", "mit", rf"mit(?:/x11)?\s+{_L}", "mit", r"opensource\.org/licenses?/mit"),
    ("mit", "expat", rf"expat\s+{_L}", "", ""),
    ("mit-0", "attribution", r"mit[\s-]+no[\s-]+attribution", "mit-0", ""),
    ("mit-0", "mit-0", r"mit-0", "", ""),
    ("mit-cmu", "cmu", rf"(?:mit[\s-]cmu|cmu[\s-]style)(?:\s+{_L})?", "mit-cmu", ""),
    ("x11", "x11", rf"x11\s+{_L}", "x11", r"xfree86\.org/current/license"),
    ("bsd-4-clause", "bsd", rf"(?:original|old|(?:4|four)[\s-]clause)\s+bsd(?:\s+{_L})?|bsd[\s-]4[\s-]clause", "bsd-4-clause", ""),
    ("bsd-3-clause", "bsd", rf"(?:new|revised|modified|(?:3|three)[\s-]clause)\s+bsd(?:\s+{_L})?|bsd[\s-]3[\s-]clause(?:\s+{_L})?", "bsd-3-clause(?:-clear|-lbnl)?", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd|(?:2|two)[\s-]clause)\s+bsd(?:\s+{_L})?|bsd[\s-]2[\s-]clause(?:\s+{_L})?", "bsd-2-clause(?:-patent|-views)?", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-1-clause", "bsd", r"bsd[\s-]1[\s-]clause", "bsd-1-clause", ""),
    ("0bsd", "bsd", rf"(?:zero[\s-]clause|0-clause)\s+bsd(?:\s+{_L})?", "0bsd", r"landley\.net/toybox/license"),
    ("bsd", "bsd", rf"bsd(?:[\s-](?:style|type|like))?\s+{_L}", "", ""),
    ("gpl-3.0", "general", rf"gnu\s+general\s+public\s+{_L}{_V}3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", "general", rf"gnu\s+general\s+public\s+{_L}{_V}2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", "general", rf"gnu\s+general\s+public\s+{_L}{_V}1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", ""),
    ("gpl", "general", rf"(?:gnu\s+)?general\s+public\s+{_L}", "", r"gnu\.org/(?:copyleft|licenses)/gpl"),
    ("gpl", "gpl", r"(?:gnu\s+)?gpl(?:[\s-]?v?[123](?:\.0)?\+?)?", "", ""),
    ("lgpl-3.0", "lesser", rf"gnu\s+lesser\s+general\s+public\s+{_L}{_V}3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", "lesser", rf"gnu\s+lesser\s+general\s+public\s+{_L}{_V}2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "library", rf"gnu\s+library\s+general\s+public\s+{_L}(?:{_V}2(?:\.0)?)?", r"lgpl-2\.0(?:-only|-or-later|\+)?", ""),
    ("lgpl", "lesser", rf"(?:gnu\s+)?lesser\s+general\s+public\s+{_L}", "", ""),
    ("lgpl", "lgpl", r"(?:gnu\s+)?lgpl(?:[\s-]?v?[23](?:\.[01])?\+?)?", "", ""),
    ("agpl-3.0", "affero", rf"(?:gnu\s+)?affero\s+general\s+public\s+{_L}(?:{_V}3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("agpl", "agpl", r"(?:gnu\s+)?agpl(?:[\s-]?v?3(?:\.0)?\+?)?", "", ""),
    ("gfdl", "documentation", rf"gnu\s+free\s+documentation\s+{_L}(?:{_V}1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later|-invariants)?", r"gnu\.org/(?:copyleft|licenses)/fdl"),
    ("mpl-2.0", "mozilla", rf"mozilla\s+public\s+{_L}{_V}2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "mozilla", rf"mozilla\s+public\s+{_L}{_V}1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-1.0", "mozilla", rf"mozilla\s+public\s+{_L}{_V}1\.0", r"mpl-1\.0", ""),
    ("mpl", "mozilla", rf"mozilla\s+public\s+{_L}", "", ""),
    ("epl-2.0", "eclipse", rf"eclipse\s+public\s+{_L}(?:{_V}2(?:\.0)?)?", r"epl-2\.0", r"eclipse\.org/legal/epl"),
    ("epl-1.0", "eclipse", rf"eclipse\s+public\s+{_L}{_V}1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("edl-1.0", "eclipse", rf"eclipse\s+distribution\s+{_L}(?:{_V}1(?:\.0)?)?", "", r"eclipse\.org/org/documents/edl"),
    ("cpl-1.0", "common", rf"common\s+public\s+{_L}(?:{_V}1\.0)?", r"cpl-1\.0", ""),
    ("cpal-1.0", "attribution", rf"common\s+public\s+attribution\s+{_L}(?:{_V}1\.0)?", r"cpal-1\.0", ""),
    ("ipl-1.0", "ibm", rf"ibm\s+public\s+{_L}(?:{_V}1\.0)?", r"ipl-1\.0", ""),
    ("cddl-1.0", "development", rf"common\s+development\s+and\s+distribution\s+{_L}(?:{_V}1(?:\.\d)?)?", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("eupl-1.2", "european", rf"european\s+union\s+public\s+{_L}(?:{_V}1\.[012])?", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl-3.0", "open", rf"open\s+software\s+{_L}(?:{_V}3(?:\.0)?)?", r"osl-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    ("afl-3.0", "academic", rf"academic\s+free\s+{_L}(?:{_V}[123]\.[012])?", r"afl-[123]\.[012]", ""),
    ("ecl-2.0", "educational", rf"educational\s+community\s+{_L}(?:{_V}2\.0)?", r"ecl-2\.0", r"opensource\.org/licenses?/ecl"),
    ("isc", "isc", rf"isc\s+{_L}", "isc", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", rf"zlib(?:/libpng)?\s+{_L}", "zlib", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", rf"libpng\s+{_L}(?:{_V}2)?", r"libpng(?:-2\.0)?", ""),
    ("curl", "curl", rf"curl\s+{_L}", "curl", r"curl\.se/docs/copyright"),
    ("ijg", "jpeg", rf"independent\s+jpeg\s+group(?:'s)?\s+{_L}", "ijg", ""),
    ("artistic-2.0", "artistic", rf"artistic\s+{_L}(?:{_V}2(?:\.0)?)?", r"artistic-2\.0", r"perlfoundation\.org/artistic"),
    ("artistic-1.0", "artistic", rf"artistic\s+{_L}{_V}1(?:\.0)?", r"artistic-1\.0(?:-perl|-cl8)?", ""),
    ("clarified-artistic", "clarified", rf"clarified\s+artistic\s+{_L}", "clartistic", ""),
    ("ms-pl", "microsoft", rf"microsoft\s+public\s+{_L}", "ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", rf"microsoft\s+reciprocal\s+{_L}", "ms-rl", ""),
    ("bsl-1.0", "boost", rf"boost\s+software\s+{_L}(?:{_V}1\.0)?", r"bsl-1\.0", r"boost\.org/license"),
    ("busl-1.1", "business", rf"business\s+source\s+{_L}(?:{_V}1\.1)?", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("elastic-2.0", "elastic", rf"elastic\s+{_L}(?:{_V}2(?:\.0)?)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("sspl-1.0", "server", rf"server\s+side\s+public\s+{_L}(?:{_V}1)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("polyform", "polyform", rf"polyform\s+(?:noncommercial|strict|shield|small\s+business|perimeter|free\s+trial|internal\s+use)(?:\s+{_L})?", r"polyform-[a-z-]{2,40}-1\.0\.0", r"polyformproject\.org/licenses"),
    ("commons-clause", "commons", r"commons\s+clause(?:\s+license\s+condition)?", "", r"commonsclause\.com"),
    ("prosperity", "prosperity", rf"prosperity\s+public\s+{_L}", r"prosperity-3\.0\.0", ""),
    ("parity", "parity", rf"parity\s+public\s+{_L}", r"parity-[67]\.0\.0", ""),
    ("psf-2.0", "python", rf"python\s+software\s+foundation\s+{_L}", r"psf-2\.0|python-2\.0", r"docs\.python\.org/\S{0,20}license"),
    ("psf-2.0", "psf", rf"psf\s+{_L}\s+agreement(?:\s+for\s+python)?", "", ""),
    ("php-3.01", "php", rf"php\s+{_L}(?:{_V}3\.0?1?)?", r"php-3\.0?1?", r"php\.net/license"),
    ("ruby", "ruby", rf"ruby(?:'s)?\s+{_L}", "ruby", r"ruby-lang\.org/\S{0,20}license"),
    ("perl", "perl", r"(?:same|perl)\s+terms\s+as\s+perl(?:\s+itself)?", "", r"dev\.perl\.org/licenses"),
    ("tcl", "tcl", rf"tcl/tk\s+{_L}", "tcl", r"tcl\.tk/software/tcltk/license"),
    ("vim", "vim", rf"vim\s+{_L}", "vim", ""),
    ("postgresql", "postgresql", rf"postgresql\s+{_L}", "postgresql", r"postgresql\.org/about/licen"),
    ("openssl", "openssl", rf"openssl\s+{_L}", "openssl", r"openssl\.org/source/license"),
    ("ncsa", "ncsa", rf"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+{_L}", "ncsa", r"opensource\.org/licenses?/ncsa"),
    ("upl-1.0", "universal", rf"universal\s+permissive\s+{_L}(?:{_V}1\.0)?", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("w3c", "w3c", rf"w3c\s+software\s+(?:notice\s+and\s+|and\s+document\s+)?{_L}", r"w3c(?:-\d{8})?", r"w3\.org/consortium/legal/\S{0,40}software"),
    ("unicode", "unicode", rf"unicode\s+{_L}(?:\s+agreement)?", r"unicode-(?:3\.0|dfs-201[56]|tou)", r"unicode\.org/(?:license|copyright)"),
    ("icu", "icu", rf"icu\s+{_L}", "icu", ""),
    ("lppl-1.3c", "latex", rf"latex\s+project\s+public\s+{_L}(?:{_V}1\.[0-3][abc]?)?", r"lppl-1\.[0-3][abc]?", r"latex-project\.org/lppl"),
    ("cecill", "cecill", rf"cecill(?:-[abc])?(?:\s+(?:free\s+software\s+)?{_L}(?:\s+agreement)?)?", r"cecill-(?:1\.[01]|2\.[01]|[abc])", r"cecill\.info/licences"),
    ("mulan-psl-2.0", "mulan", rf"mulan\s+(?:permissive\s+software|psl)(?:\s*{_L})?(?:,?\s*v?\s*2)?", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn/mulanpsl"),
    ("rpl-1.5", "reciprocal", rf"reciprocal\s+public\s+{_L}(?:{_V}1\.[15])?", r"rpl-1\.[15]", ""),
    ("qpl-1.0", "q public", rf"q public\s+{_L}(?:{_V}1\.0)?", r"qpl-1\.0", ""),
    ("sleepycat", "sleepycat", rf"sleepycat\s+{_L}", "sleepycat", ""),
    ("json", "json", rf"json\s+{_L}", "json", r"json\.org/license"),
    ("beerware", "beerware", rf"beerware(?:\s+{_L})?", "beerware", ""),
    ("beerware", "beer-ware", rf"beer-ware(?:\s+{_L})?", "", ""),
    ("hippocratic", "hippocratic", rf"hippocratic\s+{_L}(?:{_V}[23]\.[01])?", r"hippocratic-2\.1", r"firstdonoharm\.dev"),
    ("blueoak-1.0.0", "blue", rf"blue\s+oak\s+model\s+{_L}(?:{_V}1\.0\.0)?", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license"),
    ("ofl-1.1", "font", rf"sil\s+open\s+font\s+{_L}(?:{_V}1\.[01])?", r"ofl-1\.[01](?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    ("ubuntu-font", "ubuntu", rf"ubuntu\s+font\s+{_L}(?:e)?(?:{_V}1\.0)?", r"ubuntu-font-1\.0", ""),
    ("bitstream-vera", "bitstream", r"bitstream\s+vera(?:\s+fonts?)?\s+copyright", "bitstream-vera", ""),
    ("odbl-1.0", "database", rf"open\s+(?:data\s+commons\s+open\s+)?database\s+{_L}(?:{_V}1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "commons", rf"open\s+data\s+commons\s+attribution\s+{_L}(?:{_V}1\.0)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public", rf"open\s+data\s+commons\s+public\s+domain\s+dedication(?:\s+(?:and|&)\s+{_L})?", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("cdla-permissive-2.0", "community", rf"community\s+data\s+{_L}\s+agreement\s*[-–]?\s*permissive(?:{_V}[12]\.0)?", r"cdla-permissive-[12]\.0", r"cdla\.dev/permissive"),
    ("cdla-sharing-1.0", "community", rf"community\s+data\s+{_L}\s+agreement\s*[-–]?\s*sharing(?:{_V}1\.0)?", r"cdla-sharing-1\.0", r"cdla\.dev/sharing"),
    ("ogl-uk-3.0", "government", rf"open\s+government\s+{_L}(?:{_V}[123](?:\.0)?)?", r"ogl-uk-[123]\.0", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("etalab-2.0", "etalab", r"licence\s+ouverte(?:\s*/\s*open\s+licence)?\s+etalab|etalab[\s-]+(?:open\s+licence\s+)?2\.0", r"etalab-2\.0", r"etalab\.gouv\.fr/licence-ouverte"),
    ("openrail", "rail", rf"(?:creativeml\s+|bigscience\s+|bigcode\s+)?open\s*rail(?:\+{{1,2}})?(?:-[ms])?(?:\s+{_L})?", "", r"huggingface\.co/spaces/\S{0,60}license"),
    ("llama-community", "llama", rf"(?:meta\s+)?llama\s+[23](?:\.\d)?\s+community\s+{_L}(?:\s+agreement)?", "", r"llama\.meta\.com/llama\d?(?:_\d)?/license"),
    ("wtfpl", "public", rf"do\s+what\s+the\s+f\S{{2,6}}\s+you\s+want\s+to\s+public\s+{_L}", "wtfpl", ""),
    ("wtfpl", "wtfpl", rf"wtfpl(?:\s+{_L})?", "", r"wtfpl\.net"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense", "unlicense", r"unlicense\.org"),
    ("cc0-1.0", "cc0", r"cc0(?:[\s-]+1\.0)?(?:\s+universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm-1.0", "public", r"public\s+domain\s+mark(?:\s+1\.0)?", r"cc-pddc|cc-pdm-1\.0", r"creativecommons\.org/publicdomain/mark"),
]

#: (label, words of the short form, words of the long form)
CREATIVE = [
    ("cc-by", r"by", r"attribution"),
    ("cc-by-sa", r"by[\s-]+sa", r"attribution[\s-]+share[\s-]?alike"),
    ("cc-by-nd", r"by[\s-]+nd", r"attribution[\s-]+no[\s-]?deriv(?:ative)?s?"),
    ("cc-by-nc", r"by[\s-]+nc", r"attribution[\s-]+non[\s-]?commercial"),
    ("cc-by-nc-sa", r"by[\s-]+nc[\s-]+sa", r"attribution[\s-]+non[\s-]?commercial[\s-]+share[\s-]?alike"),
    ("cc-by-nc-nd", r"by[\s-]+nc[\s-]+nd", r"attribution[\s-]+non[\s-]?commercial[\s-]+no[\s-]?deriv(?:ative)?s?"),
]

#: Sentences of license texts and of the headers that name them: (label, keyword, pattern).
CLAUSES = [
    ("apache-2.0", "compliance", r"you\s+may\s+not\s+use\s+this\s+(?:file|work|software)\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("apache-2.0", "contributor", r"licensed\s+to\s+the\s+apache\s+software\s+foundation\s+\(asf\)\s+under\s+one\s+or\s+more\s+contributor\s+license\s+agreements"),
    ("apache-2.0", "limitations", r"see\s+the\s+license\s+for\s+the\s+specific\s+language\s+governing\s+permissions\s+and\s+limitations"),
    ("apache-2.0", "irrevocable", r"each\s+contributor\s+hereby\s+grants\s+to\s+you\s+a\s+perpetual,\s+worldwide,\s+non-exclusive,\s+no-charge,\s+royalty-free,\s+irrevocable"),
    ("apache-1.1", "apache", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation"),
    ("mit", "obtaining", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("mit", "substantial", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+(?:\(including\s+the\s+next\s+paragraph\)\s+)?shall\s+be\s+included\s+in\s+all\s+copies\s+or\s+substantial\s+portions"),
    ("mit", "merchantability", r"the\s+software\s+is\s+provided\s+[\"'“]as\s+is[\"'”],\s+without\s+warranty\s+of\s+any\s+kind,\s+express\s+or\s+implied,\s+including\s+but\s+not\s+limited\s+to\s+the\s+warranties\s+of\s+merchantability"),
    ("bsd", "redistribution", r"redistributions?\s+of\s+source\s+code\s+must\s+retain\s+the\s+(?:above\s+)?copyright\s+notice"),
    ("bsd", "redistribution", r"redistributions?\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+(?:above\s+)?copyright\s+notice"),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification"),
    ("bsd-3-clause", "endorse", r"neither\s+the\s+names?\s+of\s+.{1,120}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products"),
    ("bsd-4-clause", "advertising", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software\s+must\s+display"),
    ("bsd-source-code", "redistribution", r"redistribution\s+and\s+use\s+of\s+this\s+software\s+in\s+source\s+and\s+binary\s+forms"),
    ("bsd", "consequential", r"in\s+no\s+event\s+shall\s+the\s+copyright\s+(?:holders?|owners?)\s+(?:or|and)\s+contributors\s+be\s+liable\s+for\s+any\s+direct,\s+indirect,\s+incidental,\s+special,\s+exemplary,\s+or\s+consequential"),
    ("gpl", "redistribute", r"(?:this\s+(?:program|file|library)|.{1,60}?)\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl-3.0-or-later", "later", r"either\s+version\s+3\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("gpl-2.0-or-later", "later", r"either\s+version\s+2\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("lgpl-2.1-or-later", "later", r"either\s+version\s+2\.1\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("gpl-2.0-only", "version", r"under\s+the\s+terms\s+of\s+version\s+2\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("gpl-3.0-only", "version", r"under\s+the\s+terms\s+of\s+version\s+3\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("gpl", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("lgpl", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+license"),
    ("agpl", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license"),
    ("gpl", "useful", r"distributed\s+in\s+the\s+hope\s+that\s+it\s+will\s+be\s+useful,\s+but\s+without\s+any\s+warranty"),
    ("gpl", "franklin", r"51\s+franklin\s+st(?:reet)?,\s+fifth\s+floor,\s+boston"),
    ("gpl", "temple", r"59\s+temple\s+place,?\s+(?:-\s+)?suite\s+330,\s+boston"),
    ("gpl-classpath-exception", "classpath", r"(?:gpl|general\s+public\s+license)?.{0,40}?with\s+(?:the\s+)?classpath\s+exception"),
    ("gcc-exception", "runtime", r"gcc\s+runtime\s+library\s+exception"),
    ("linking-exception", "exception", r"as\s+a\s+special\s+exception,\s+the\s+copyright\s+holders?\s+(?:of\s+this\s+library\s+)?give\s+you\s+permission\s+to\s+link"),
    ("autoconf-exception", "autoconf", r"as\s+a\s+special\s+exception.{0,120}?autoconf"),
    ("gfdl", "invariant", r"with\s+no\s+invariant\s+sections,\s+(?:with\s+)?no\s+front-cover\s+texts"),
    ("gfdl", "documentation", r"permission\s+is\s+granted\s+to\s+copy,\s+distribute\s+and/or\s+modify\s+this\s+document\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+free\s+documentation"),
    ("mpl-2.0", "source code form", r"this\s+source code form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla"),
    ("mpl-2.0", "mpl", r"if\s+a\s+copy\s+of\s+the\s+mpl\s+was\s+not\s+distributed\s+with\s+this"),
    ("mpl-1.1", "contents", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+license\s+version\s+1\.1"),
    ("mpl-1.1", "tri-license", r"mpl\s+1\.1/gpl\s+2\.0/lgpl\s+2\.1(?:\s+tri-license)|tri-license\s+mpl"),
    ("npl-1.1", "netscape", r"netscape\s+public\s+license(?:\s+version\s+1\.[01])?"),
    ("epl-2.0", "accompanying", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license"),
    ("cddl-1.0", "development", r"subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+license"),
    ("eupl-1.2", "eupl", r"licensed\s+under\s+the\s+eupl(?:,?\s+version\s+1\.[012])?"),
    ("isc", "purpose", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted"),
    ("isc", "disclaims", r"the\s+author\s+disclaims\s+all\s+warranties\s+with\s+regard\s+to\s+this\s+software"),
    ("hpnd", "advertising", r"not\s+be\s+used\s+in\s+advertising\s+or\s+publicity\s+pertaining\s+to\s+distribution\s+of\s+the\s+software"),
    ("zlib", "misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("zlib", "plainly", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("bsl-1.0", "boost", r"distributed\s+under\s+the\s+boost\s+software\s+license"),
    ("bsl-1.0", "executable", r"machine-executable\s+object\s+code\s+generated\s+by\s+a\s+source\s+language\s+processor"),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("cc0-1.0", "dedicated", r"dedicated\s+all\s+copyright\s+and\s+related\s+and\s+neighboring\s+rights\s+to\s+this\s+(?:software|work)\s+to\s+the\s+public\s+domain"),
    ("wtfpl", "want to", r"you\s+just\s+do\s+what\s+the\s+f\S{2,6}\s+you\s+want to"),
    ("beerware", "return", r"you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return"),
    ("json", "evil", r"the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("openssl", "openssl", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project"),
    ("ssleay", "cryptographic", r"this\s+product\s+includes\s+cryptographic\s+software\s+written\s+by\s+eric\s+young"),
    ("libtiff", "silicon", r"sam\s+leffler\s+and\s+silicon\s+graphics"),
    ("ijg", "jpeg", r"this\s+software\s+is\s+based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg\s+group"),
    ("ftl", "freetype", r"portions\s+of\s+this\s+software\s+are\s+copyright.{0,40}?the\s+freetype\s+project"),
    ("postgresql", "california", r"in\s+no\s+event\s+shall\s+the\s+university\s+of\s+california\s+be\s+liable\s+to\s+any\s+party"),
    ("ncsa", "names", r"neither\s+the\s+names\s+of\s+.{1,80}?\s+nor\s+the\s+names\s+of\s+its\s+contributors\s+may\s+be\s+used"),
    ("ofl-1.1", "reserved font", r"with\s+reserved font\s+names?"),
    ("ofl-1.1", "bundled", r"the\s+fonts,\s+including\s+any\s+derivative\s+works,\s+can\s+be\s+bundled"),
    ("lppl-1.3c", "latex", r"this\s+work\s+may\s+be\s+distributed\s+and/or\s+modified\s+under\s+the\s+conditions\s+of\s+the\s+latex"),
    ("sspl-1.0", "service source", r"making\s+available\s+the\s+service source\s+code|offering\s+the\s+program\s+as\s+a\s+service source"),
    ("busl-1.1", "change date", r"change date\s*:\s*\d{4}-\d\d-\d\d"),
    ("busl-1.1", "additional use", r"additional use\s+grant\s*:"),
    ("elastic-2.0", "managed", r"provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service"),
    ("commons-clause", "sell", r"the\s+license\s+does\s+not\s+include,\s+the\s+right\s+to\s+sell\s+the\s+software"),
    ("openrail", "use-based", r"use-based\s+restrictions?\s+as\s+referenced\s+in\s+paragraph\s+5"),
    ("python", "beopen", r"beopen\s+python\s+open\s+source\s+license\s+agreement"),
    ("python", "cnri", r"cnri\s+(?:open\s+source\s+)?license\s+agreement"),
    ("ruby", "ruby", r"you\s+may\s+(?:copy|distribute)\s+it\s+under\s+the\s+same\s+terms\s+as\s+ruby"),
    ("perl", "perl", r"you\s+(?:can|may)\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+same\s+terms\s+as\s+perl"),
    ("php-3.01", "php", r"this\s+product\s+includes\s+php\s+software"),
    ("nist-pd", "nist", r"this\s+software\s+was\s+developed\s+(?:at|by)\s+(?:the\s+national\s+institute\s+of\s+standards\s+and\s+technology\s*)?\(?nist\)?"),
    ("us-government-work", "government", r"(?:work|works)\s+of\s+the\s+(?:u\.?s\.?|united\s+states)\s+government"),
    ("far-restricted", "restricted", r"restricted\s+rights\s+(?:legend|notice)|u\.?s\.?\s+government\s+restricted\s+rights"),
    ("dfars", "dfars", r"dfars\s+\d{3}\.\d{3}-\d{4}"),
]

#: Notices that say something on rights without a license's name: (label, keyword, pattern, weight).
NOTICES = [
    ("reserved", "rights", r"all\s+rights\s+reserved", 0.6),
    ("reserved", "rights", r"some\s+rights\s+reserved", 0.4),
    ("reserved", "droits", r"tous\s+droits\s+r[eé]serv[eé]s", 0.6),
    ("reserved", "rechte", r"alle\s+rechte\s+vorbehalten", 0.6),
    ("reserved", "derechos", r"todos\s+los\s+derechos\s+reservados", 0.6),
    ("reserved", "diritti", r"tutti\s+i\s+diritti\s+riservati", 0.6),
    ("reserved", "direitos", r"todos\s+os\s+direitos\s+reservados", 0.6),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)\s+|©\s*)?(?:19|20)\d\d(?:\s*[-,–]\s*(?:19|20)\d\d)*+", 0.4),
    ("copyright", "(c)", r"\(c\)\s+(?:19|20)\d\d", 0.3),
    ("copyright", "©", r"©\s*(?:19|20)\d\d", 0.3),
    ("copyright", "copyright", r"copyright\s+by\s+the\s+(?:author|authors|publisher)", 0.4),
    ("copyright", "copyrighted", r"copyrighted\s+(?:material|works?|software|content)", 0.4),
    ("public-domain", "domain", r"(?:released\s+(?:in)?to|in|dedicated\s+to|placed\s+in(?:to)?)\s+the\s+public\s+domain", 0.6),
    ("public-domain", "domain", r"public\s+domain\s+(?:dedication|work|software|image|book)", 0.5),
    ("public-domain", "gemeinfrei", r"gemeinfrei", 0.5),
    ("public-domain", "domaine", r"domaine\s+public", 0.4),
    ("public-domain", "dominio", r"dominio\s+p[uú]blico", 0.4),
    ("proprietary", "proprietary", rf"proprietary\s+(?:and\s+confidential|{_L}|software|information|rights)", 0.5),
    ("proprietary", "confidential", r"confidential\s+and\s+proprietary", 0.5),
    ("proprietary", "trade", r"(?:contains|constitutes?)\s+(?:valuable\s+)?trade\s+secrets?", 0.5),
    ("proprietary", "unpublished", r"unpublished\s+(?:work|proprietary\s+source\s+code|rights\s+reserved)", 0.5),
    ("proprietary", "internal", r"for\s+internal\s+use\s+only", 0.4),
    ("proprietary", "distribute", r"do\s+not\s+(?:copy\s+or\s+)?(?:re)?distribute", 0.4),
    ("proprietary", "unauthori", r"unauthori[sz]ed\s+(?:copying|use|reproduction|distribution|duplication)\s+(?:of\s+this\s+\S{1,20}\s+)?(?:is\s+)?(?:strictly\s+)?prohibited", 0.5),
    ("proprietary", "permission", r"(?:no\s+part\s+of\s+this\s+(?:publication|book|work|document)\s+may\s+be\s+reproduced.{0,160}?|reproduced\s+)without\s+(?:the\s+)?(?:prior\s+)?(?:written\s+)?permission", 0.5),
    ("proprietary", "consent", r"without\s+(?:the\s+)?(?:express\s+|prior\s+){0,2}written\s+consent", 0.4),
    ("eula", "end", rf"end[\s-]user\s+{_L}(?:\s+agreement)?", 0.5),
    ("eula", "terms", r"terms\s+(?:of\s+(?:use|service)|and\s+conditions\s+of\s+use)", 0.2),
    ("non-commercial", "commercial", r"(?:for\s+)?non[\s-]?commercial\s+(?:use|purposes?)(?:\s+only)?", 0.4),
    ("non-commercial", "commercial", r"not\s+for\s+commercial\s+(?:use|purposes?|redistribution)", 0.4),
    ("non-commercial", "personal", r"for\s+personal(?:,?\s+(?:and\s+)?non[\s-]?commercial)?\s+use\s+only", 0.4),
    ("academic", "research", r"for\s+(?:academic\s+and\s+)?(?:non-profit\s+)?research\s+(?:and\s+educational\s+)?(?:use|purposes)(?:\s+only)?", 0.3),
    ("academic", "academic", r"academic\s+(?:use\s+only|public\s+license)", 0.3),
    ("evaluation", "evaluation", rf"evaluation\s+(?:{_L}|copy|version|purposes\s+only)", 0.3),
    ("shareware", "shareware", r"shareware", 0.3),
    ("freeware", "freeware", r"freeware", 0.3),
    ("no-derivatives", "derivative", r"no\s+derivative\s+works", 0.3),
    ("attribution", "attribution", r"attribution\s+(?:is\s+)?required", 0.3),
    ("attribution", "permission", r"(?:used|reprinted|reproduced)\s+(?:here\s+)?(?:with|by)\s+(?:kind\s+)?permission", 0.3),
    ("fair-use", "fair", r"fair\s+use\s+(?:notice|doctrine|act)", 0.3),
    ("dmca", "dmca", r"dmca(?:\s+(?:notice|takedown|policy))?", 0.2),
    ("dmca", "millennium", r"digital\s+millennium\s+copyright\s+act", 0.2),
    ("patent", "patent", r"patents?\s+pending", 0.2),
    ("patent", "patent", r"(?:u\.?s\.?|european)\s+patents?\s+(?:no\.?|numbers?|nos\.?)\s*[\d,]{5,12}", 0.2),
    ("trademark", "trademark", r"(?:registered\s+)?trademarks?\s+of\s+(?:their\s+respective\s+owners|the\s+\w{1,30}\s+(?:foundation|corporation|project))", 0.2),
    ("no-warranty", "warrant", r"without\s+(?:any\s+)?warranty\s+of\s+any\s+kind|as\s+is[\"']?,?\s+without\s+(?:any\s+)?warrant(?:y|ies)|absolutely\s+no\s+warranty", 0.2),
    ("no-warranty", "as-is", r"(?:provided|distributed|available|software)\s+(?:on\s+an\s+)?[\"'“]?as-is[\"'”]?", 0.2),
    ("no-liability", "liable", r"in\s+no\s+event\s+(?:shall|will)\s+.{1,80}?\s+be\s+(?:held\s+)?liable", 0.2),
    ("copyleft", "copyleft", r"(?:strong\s+|weak\s+|no\s+)?copyleft", 0.2),
    ("open-source", "open", rf"(?:osi[\s-]approved\s+)?open[\s-]source\s+(?:initiative|{_L}s?)", 0.2),
    ("free-software", "foundation", r"free\s+software\s+foundation", 0.2),
    ("dual-license", "dual", rf"dual[\s-]{_L}d?|dual[\s-]licensing", 0.3),
    ("cla", "contributor", rf"contributor\s+{_L}\s+agreement", 0.2),
    ("dco", "certificate", r"developer\s+certificate\s+of\s+origin", 0.2),
    ("licensed", "licen", r"licen[cs]ed\s+(?:under|to\s+you\s+under)\s+(?:the\s+)?(?:terms\s+of\s+)?", 0.1),
    ("licensed", "licen", r"see\s+(?:the\s+)?(?:file\s+)?licen[cs]e(?:\.(?:txt|md))?\s+(?:file\s+)?for\s+(?:details|more|terms|licensing)", 0.2),
]


def rules() -> list[tuple]:
    """(number, label, stem, keyword, pattern, priority, weight, group) of all signatures in order; group 1 completes the label."""
    out: list[tuple] = []
    edge, end = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    grant = r"(?:licen[cs]ed|released|distributed|available|published|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"

    def add(label: str, keyword: str, pattern: str, priority: int, weight: float, group: int = 0, named: str = "") -> None:
        out.append((len(out), label, stem_of(named or pattern, keyword), keyword, pattern, priority, weight, group))

    for label, keyword, name, ids, address in FAMILIES:
        if ids:
            add(label, "spdx", rf"spdx-license-identifier:\s*(?:{ids}){end}", 0, 1.0)
            add(label, "licen", rf"licen[cs]e[\"']?\s*[:=]\s*[\"']?(?:{ids}){end}", 1, 0.9)
        add(label, keyword, rf"{edge}{grant}(?:{name}){end}", 1, 0.95, named=name)
        add(label, keyword, rf"{edge}(?:{name}){end}", 2, 0.8, named=name)
        if address:
            add(label, max(always(address), key=len), rf"(?:https?://)?(?:www\.)?(?:{address})\S*", 1, 0.9, named=address)
    version, tail = r"[\s-]+(?:v(?:ersion)?\s*)?", r"(?:[\s-]+(?:international|unported|generic|licen[cs]e)){0,2}"
    number = rf"(?:{version}([1-4]\.[05]))?"
    for label, short, long in CREATIVE:
        add(label, "spdx", rf"spdx-license-identifier:\s*{label}-([1-4]\.[05])", 0, 1.0, 1)
        add(label, "cc", rf"{edge}cc[\s-]+{short}{number}{end}", 2, 0.8, 1)
        add(label, "creativecommons", rf"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/{label[3:]}(?:/([1-4]\.[05])\S*|(?![a-z0-9-]))", 1, 0.9, 1)
        add(label, "creative", rf"{edge}creative\s+commons\s+{long}{tail}{number}{end}", 2, 0.85, 1)
    for label, keyword, pattern in CLAUSES:
        add(label, keyword, pattern, 1, 0.9)
    for label, keyword, pattern, weight in NOTICES:
        add(label, keyword, pattern, 9 if label == "licensed" else 3, weight)
    return out


def always(pattern: str) -> list[str]:
    """Runs of literal characters that every match holds: those outside all groups; none if there is a choice outside them."""
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            c, at = pattern[at], at + 1
            literal = not c.isalnum()
        elif c == "[":
            at = pattern.index("]", at + 1) + 1
            literal = False
        else:
            literal = c not in "()?*+|.{}^$"
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                return []
            if c in "?*":
                run = run[:-1]
            if c == "{":
                run, at = run[:-1], pattern.index("}", at) + 1
        if depth:
            literal = False
        if literal:
            run += c
        else:
            runs.append(run)
            run = ""
    return [r for r in [*runs, run] if r]


def stem_of(pattern: str, keyword: str) -> str:
    """The first word of STEMS that every match holds, else the keyword: texts without it are not asked for the keyword."""
    held = [keyword, *always(pattern)]
    return next((s for s in STEMS if any(s in r for r in held)), keyword)
