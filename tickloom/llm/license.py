"""License scan by ordered signature rules, in DataFrame and SQL functions only.

A text becomes its words (A-Z lower-cased) joined by single spaces. A prefilter of literals tells whether any rule could
match at all; for texts that pass, each rule runs only if one of its keywords is a word of the text. Matches are word intervals.
Sorted by start, a match inside another of the same or a higher priority is suppressed; what is left names the labels.
The base phrases count in any case, and their labels always stay.

Cases: null and empty texts have no words and no label; a rule's matches don't overlap each other; equal intervals keep
the rule with the higher priority, then the label that sorts first. Each row gives one row.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase and label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label, keywords (one of them is a word of every match), the licence's name as a regex over words, its identifier as words.
NAMES = [
    ("apache-2.0", "apache", r"apache (software )?licen[cs]e(,? version)?( v)? ?2( 0)?", "apache 2 0"),
    ("apache-1.1", "apache", r"apache (software )?licen[cs]e( version)? 1 1", "apache 1 1"),
    ("apache", "apache", r"apache (software )?licen[cs]e", "apache"),
    ("mit", "mit expat", r"(mit|expat) licen[cs]e", "mit"),
    ("mit-0", "mit", r"mit no attribution( licen[cs]e)?", "mit 0"),
    ("x11", "x11", r"x11 licen[cs]e", "x11"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("bsd", "bsd berkeley", r"(berkeley software distribution|bsd) licen[cs]e", "bsd"),
    ("bsd-2-clause", "bsd", r"((simplified|freebsd) bsd|(2|two) clause bsd|bsd (2|two) clause) licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"((new|modified|revised) bsd|(3|three) clause bsd|bsd (3|three) clause) licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(original bsd|(4|four) clause bsd|bsd (4|four) clause) licen[cs]e", "bsd 4 clause"),
    ("0bsd", "bsd 0bsd clausebsd", r"(zero clause|0) ?bsd( licen[cs]e)?", "0bsd"),
    ("gpl-1.0", "general", r"(gnu )?general public licen[cs]e( gpl)?( as published by the free software foundation)?( either)?( version| v) ?1( 0)?", "gpl 1 0"),
    ("gpl-2.0", "general", r"(gnu )?general public licen[cs]e( gpl)?( as published by the free software foundation)?( either)?( version| v) ?2( 0)?", "gpl 2 0"),
    ("gpl-3.0", "general", r"(gnu )?general public licen[cs]e( gpl)?( as published by the free software foundation)?( either)?( version| v) ?3( 0)?", "gpl 3 0"),
    ("gpl-2.0-short", "gpl gplv2 gpl2", r"(gnu )?gpl ?v?2( 0)?", "gpl 2 0 only"),
    ("gpl-3.0-short", "gpl gplv3 gpl3", r"(gnu )?gpl ?v?3( 0)?", "gpl 3 0 only"),
    ("lgpl", "lesser library", r"(gnu )?(lesser|library) general public licen[cs]e", "lgpl"),
    ("lgpl-2.1", "lesser", r"(gnu )?lesser general public licen[cs]e( lgpl)?( version| v) ?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(gnu )?lesser general public licen[cs]e( lgpl)?( version| v) ?3( 0)?", "lgpl 3 0"),
    ("agpl", "affero", r"(gnu )?affero general public licen[cs]e", "agpl"),
    ("agpl-3.0", "affero", r"(gnu )?affero general public licen[cs]e( agpl)?( version| v) ?3( 0)?", "agpl 3 0"),
    ("gfdl", "documentation", r"(gnu )?free documentation licen[cs]e", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e( mpl)?( version| v) ?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e( mpl)?( version| v) ?2( 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e( epl)?( version| v) ?1( 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e( epl)?( version| v) ?2( 0)?", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "epl"),
    ("eupl", "union", r"european union public licen[cs]e( v?1 [12])?", "eupl 1 2"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e( 1 [01])?", "cddl 1 0"),
    ("cpl", "common", r"common public licen[cs]e( version)?( 1 0)?", "cpl 1 0"),
    ("artistic", "artistic", r"artistic licen[cs]e( version)?( [12]( 0)?)?", "artistic 2 0"),
    ("boost", "boost", r"boost software licen[cs]e( version)?( 1( 0)?)?", "bsl 1 0"),
    ("zlib", "zlib", r"zlib( libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", "libpng"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("python-2.0", "python", r"python( software foundation)? licen[cs]e( version)?( 2( 0)?)?", "python 2 0"),
    ("php-3.01", "php", r"php licen[cs]e( version)?( 3 01?)?", "php 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("unlicense", "unlicense", r"(the )?unlicense", "unlicense"),
    ("wtfpl", "want", r"do what the fuck you want to public licen[cs]e", "wtfpl"),
    ("ofl-1.1", "font", r"(sil )?open font licen[cs]e( version)?( 1 1)?", "ofl 1 1"),
    ("odbl", "database", r"open database licen[cs]e", "odbl 1 0"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e( version)?( 2 0)?", "ecl 2 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("afl-3.0", "academic", r"academic free licen[cs]e( version)?( 3( 0)?)?", "afl 3 0"),
    ("osl-3.0", "open", r"open software licen[cs]e( version)?( 3( 0)?)?", "osl 3 0"),
    ("ncsa", "illinois", r"university of illinois( ncsa)? open source licen[cs]e", "ncsa"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("vim", "vim", r"vim licen[cs]e", "vim"),
    ("w3c", "w3c", r"w3c( software)?( notice and)? licen[cs]e", "w3c"),
    ("sspl", "server", r"server side public licen[cs]e", "sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e( 2( 0)?)?", "elastic 2 0"),
    ("bsl-1.1", "business", r"business source licen[cs]e( 1 1)?", "busl 1 1"),
    ("cc0-1.0", "cc0", r"cc0( 1 0)?( universal)?", "cc0 1 0"),
    ("gpl-2.0", "gpl", r"(gnu )?gpl( version| licen[cs]e version) 2( 0)?", "gpl 2 0 or later"),
    ("gpl-3.0", "gpl", r"(gnu )?gpl( version| licen[cs]e version) 3( 0)?", "gpl 3 0 or later"),
    ("gpl", "gpl", r"gnu gpl", "gpl"),
    ("lgpl-2.1", "lgpl lgplv2 lgpl2", r"(gnu )?lgpl( version)? ?v?2( 1)?", "lgpl 2 1 only"),
    ("lgpl-3.0", "lgpl lgplv3 lgpl3", r"(gnu )?lgpl( version)? ?v?3( 0)?", "lgpl 3 0 only"),
    ("lgpl-2.0", "library", r"(gnu )?library general public licen[cs]e( lgpl)?( version| v) ?2( 0)?", "lgpl 2 0"),
    ("agpl-3.0", "agpl agplv3 agpl3", r"(gnu )?agpl( version)? ?v?3( 0)?", "agpl 3 0 only"),
    ("gfdl-1.1", "documentation", r"(gnu )?free documentation licen[cs]e( gfdl)?( version)? 1 1", "gfdl 1 1"),
    ("gfdl-1.2", "documentation", r"(gnu )?free documentation licen[cs]e( gfdl)?( version)? 1 2", "gfdl 1 2"),
    ("gfdl-1.3", "documentation", r"(gnu )?free documentation licen[cs]e( gfdl)?( version)? 1 3", "gfdl 1 3 only"),
    ("gnu-all-permissive", "permissive", r"gnu all permissive licen[cs]e", "fsfap"),
    ("apache-1.0", "apache", r"apache (software )?licen[cs]e( version)? 1 0", "apache 1 0"),
    ("apple-psl", "apple", r"apple public source licen[cs]e( version)?( [12] [012])?", "apsl 2 0"),
    ("adaptive", "adaptive", r"adaptive public licen[cs]e( version)?( 1 0)?", "apl 1 0"),
    ("aladdin", "aladdin", r"aladdin free public licen[cs]e", "aladdin"),
    ("attribution-assurance", "assurance", r"attribution assurance licen[cs]e", "aal"),
    ("beerware", "beerware beer", r"(beerware|beer ware)( licen[cs]e)?", "beerware"),
    ("bittorrent", "bittorrent", r"bittorrent open source licen[cs]e( 1 [01])?", "bittorrent 1 1"),
    ("blue-oak", "oak", r"blue oak model licen[cs]e( 1 0( 0)?)?", "blueoak 1 0 0"),
    ("bsd-1-clause", "bsd", r"((1|one) clause bsd|bsd (1|one) clause) licen[cs]e", "bsd 1 clause"),
    ("bsd-protection", "protection", r"bsd protection licen[cs]e", "bsd protection"),
    ("bsd-2-clause-patent", "patent", r"bsd( 2 clause)? plus patent licen[cs]e", "bsd 2 clause patent"),
    ("bsd-3-clause-clear", "clear", r"(clear bsd|bsd 3 clause clear) licen[cs]e", "bsd 3 clause clear"),
    ("cecill", "cecill", r"cecill( free software)? licen[cs]e( agreement)?( version)?( [12] [01])?", "cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b( licen[cs]e)?", "cecill b"),
    ("cecill-c", "cecill", r"cecill c( licen[cs]e)?", "cecill c"),
    ("cern-ohl", "cern", r"cern open hardware licen[cs]e( version)?( [12]( [02])?)?", "cern ohl 1 2"),
    ("clarified-artistic", "clarified", r"clarified artistic licen[cs]e", "clartistic"),
    ("cnri-python", "cnri", r"cnri( open source)?( python)? licen[cs]e( agreement)?", "cnri python"),
    ("commons-clause", "commons", r"commons clause( licen[cs]e)?( condition)?( v1 0)?", "commons clause"),
    ("confluent", "confluent", r"confluent community licen[cs]e( agreement)?( version)?( 1 0)?", "confluent community 1 0"),
    ("copyleft-next", "copyleft", r"copyleft next( 0 3 [01])?", "copyleft next 0 3 1"),
    ("cpal-1.0", "attribution", r"common public attribution licen[cs]e( version)?( 1 0)?", "cpal 1 0"),
    ("cua-opl", "cua", r"cua office public licen[cs]e( version)?( 1 0)?", "cua opl 1 0"),
    ("d-fsl", "deutsche", r"deutsche freie software lizenz", "d fsl 1 0"),
    ("ecos-2.0", "ecos", r"ecos licen[cs]e( version)?( 2 0)?", "ecos 2 0"),
    ("eiffel", "eiffel", r"eiffel forum licen[cs]e( version)?( [12])?( 0)?", "efl 2 0"),
    ("entessa", "entessa", r"entessa public licen[cs]e( version)?( 1 0)?", "entessa"),
    ("erlang-pl", "erlang", r"erlang public licen[cs]e( version)?( 1 1)?", "erlpl 1 1"),
    ("etalab", "etalab ouverte", r"(licence ouverte|etalab( open)? licen[cs]e)( version)?( [12] 0)?", "etalab 2 0"),
    ("eu-datagrid", "datagrid", r"eu datagrid software licen[cs]e", "eudatagrid"),
    ("fair", "fair", r"fair licen[cs]e", "fair"),
    ("frameworx", "frameworx", r"frameworx open licen[cs]e( 1 0)?", "frameworx 1 0"),
    ("free-art", "art", r"free art licen[cs]e( 1 [23])?", "lal 1 3"),
    ("freetype", "freetype", r"freetype( project)? licen[cs]e", "ftl"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e( version)?( [123] [01])?", "hippocratic 2 1"),
    ("hpnd", "historical", r"historical permission notice and disclaimer", "hpnd"),
    ("ibm-pl", "ibm", r"ibm public licen[cs]e( version)?( 1 0)?", "ipl 1 0"),
    ("icu", "icu", r"icu licen[cs]e", "icu"),
    ("ijg", "jpeg", r"independent jpeg group licen[cs]e", "ijg"),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", "imagemagick"),
    ("infozip", "zip", r"info zip licen[cs]e", "info zip"),
    ("intel", "intel", r"intel open source licen[cs]e", "intel"),
    ("jabber", "jabber", r"jabber open source licen[cs]e", "jabberpl"),
    ("json", "json", r"json licen[cs]e", "json"),
    ("lgpllr", "linguistic", r"lesser general public licen[cs]e for linguistic resources", "lgpllr"),
    ("libtiff", "libtiff", r"libtiff licen[cs]e", "libtiff"),
    ("linux-syscall", "linux", r"linux syscall note", "linux syscall note"),
    ("lppl-1.3", "latex", r"latex project public licen[cs]e( version)?( 1 [0123][ac]?)?", "lppl 1 3c"),
    ("lucent", "lucent", r"lucent public licen[cs]e( version)?( 1 0[02]?)?", "lpl 1 02"),
    ("miros", "miros", r"miros licen[cs]e", "miros"),
    ("mit-cmu", "cmu", r"cmu licen[cs]e", "mit cmu"),
    ("mit-modern", "modern", r"modern mit licen[cs]e", "mit modern variant"),
    ("motosoto", "motosoto", r"motosoto open source licen[cs]e", "motosoto"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e( mpl)?( version| v) ?1 0", "mpl 1 0"),
    ("mpl-short", "mpl mpl1 mpl2 mplv1 mplv2", r"mpl ?v?[12]( [01])?", "mpl 2 0 no copyleft exception"),
    ("mulan-psl", "mulan mulanpsl", r"mulan( permissive software|psl) licen[cs]e( version)?( [12])?", "mulanpsl 2 0"),
    ("multics", "multics", r"multics licen[cs]e", "multics"),
    ("nasa-1.3", "nasa", r"nasa open source agreement( version)?( 1 3)?", "nasa 1 3"),
    ("naumen", "naumen", r"naumen public licen[cs]e", "naumen"),
    ("netcdf", "netcdf", r"netcdf licen[cs]e", "netcdf"),
    ("nethack", "nethack", r"nethack general public licen[cs]e", "ngpl"),
    ("nokia", "nokia", r"nokia open source licen[cs]e( version)?( 1 0a)?", "nokia"),
    ("non-profit-osl", "profit", r"non profit open software licen[cs]e( 3 0)?", "nposl 3 0"),
    ("npl", "netscape", r"netscape public licen[cs]e( version)?( 1 [01])?", "npl 1 1"),
    ("ntp", "ntp", r"ntp licen[cs]e", "ntp"),
    ("oclc", "oclc", r"oclc research public licen[cs]e( 2 0)?", "oclc 2 0"),
    ("odc-by", "commons", r"open data commons attribution licen[cs]e( v?1 0)?", "odc by 1 0"),
    ("ogl", "government", r"open government licen[cs]e( v?[123]( 0)?)?", "ogl uk 3 0"),
    ("open-font-1.0", "font", r"(sil )?open font licen[cs]e( version)? 1 0", "ofl 1 0"),
    ("openldap", "openldap", r"openldap public licen[cs]e( version)?( 2 [0-9])?", "oldap 2 8"),
    ("open-group", "group", r"open group test suite licen[cs]e", "ogtsl"),
    ("parity", "parity", r"parity public licen[cs]e( [67] 0 0)?", "parity 7 0 0"),
    ("pddl", "dedication", r"(open data commons )?public domain dedication and licen[cs]e( 1 0)?", "pddl 1 0"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial licen[cs]e( 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("polyform-small-business", "polyform", r"polyform small business licen[cs]e( 1 0 0)?", "polyform small business 1 0 0"),
    ("prosperity", "prosperity", r"prosperity public licen[cs]e( 3 0 0)?", "prosperity 3 0 0"),
    ("qpl-1.0", "q", r"q public licen[cs]e( version)?( 1 0)?", "qpl 1 0"),
    ("realnetworks", "realnetworks", r"realnetworks public source licen[cs]e( version)?( 1 0)?", "rpsl 1 0"),
    ("redis-sal", "redis", r"redis source available licen[cs]e( agreement)?( v2)?", "rsalv2"),
    ("rpl", "reciprocal", r"reciprocal public licen[cs]e( version)?( 1 [135])?", "rpl 1 5"),
    ("ricoh", "ricoh", r"ricoh source code public licen[cs]e", "rscpl"),
    ("sgi-b", "sgi", r"sgi free software licen[cs]e b( version)?( [12] [01])?", "sgi b 2 0"),
    ("simple-pl", "simple", r"simple public licen[cs]e( 2 0)?", "simpl 2 0"),
    ("sissl", "sun", r"sun industry standards source licen[cs]e( version)?( 1 [12])?", "sissl"),
    ("sleepycat", "sleepycat", r"sleepycat( public)? licen[cs]e", "sleepycat"),
    ("sun-pl", "sun", r"sun public licen[cs]e( version)?( 1 0)?", "spl 1 0"),
    ("sybase", "sybase", r"sybase open watcom public licen[cs]e( version)?( 1 0)?", "watcom 1 0"),
    ("tcl", "tcl", r"tcl tk licen[cs]e", "tcl"),
    ("timescale", "timescale", r"timescale licen[cs]e( agreement)?", "timescale"),
    ("trusster", "trusster", r"trusster open source licen[cs]e", "tosl"),
    ("unicode", "unicode", r"unicode( data files and software)? licen[cs]e( agreement)?( v3)?", "unicode 3 0"),
    ("unicode-dfs", "unicode", r"unicode terms of use", "unicode tou"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e( version)?( v?1 0)?", "upl 1 0"),
    ("vovida", "vovida", r"vovida software licen[cs]e( version)?( 1 0)?", "vsl 1 0"),
    ("w3c-doc", "w3c", r"w3c document licen[cs]e", "w3c 19980720"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e( version)?( 3 1)?", "wxwindows"),
    ("x-net", "net", r"x net licen[cs]e", "xnet"),
    ("xfree86", "xfree86", r"xfree86( project)? licen[cs]e( 1 [01])?", "xfree86 1 1"),
    ("zope", "zope", r"zope public licen[cs]e( version)?( [12] [01])?", "zpl 2 1"),
    ("anti-996", "996", r"anti 996 licen[cs]e( version)?( 1 0)?", "anti 996 1 0"),
    ("llama", "llama", r"llama [23]( [123])? community licen[cs]e( agreement)?", "llama community"),
    ("openrail", "openrail rail", r"(open ?rail|responsible ai licen[cs]e rail)( m)?( licen[cs]e)?", "openrail m"),
]
#: Versions and parts of Creative Commons licences; the rules below are built from them.
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(ative)?s?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(ative)?s?"}
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0", "")
#: label, keywords, regex, priority: notices that name no licence.
NOTICES = [
    ("copyright", "copyright", r"copyright( c)? (19|20)[0-9]{2}", 1),
    ("reserved", "rights", r"(all|some|no) rights reserved", 1),
    ("public-domain", "domain", r"(in|into|to) the public domain", 2),
    ("no-warranty", "warranty", r"without (any )?warranty( of any kind)?", 1),
    ("no-warranty", "warranties", r"without warranties or conditions of any kind", 1),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 3),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 3),
    ("proprietary", "proprietary", r"proprietary( and confidential)?( information| software| licen[cs]e)", 2),
    ("proprietary", "confidential", r"confidential and proprietary", 2),
    ("licensed", "licensed", r"licensed (under|to|by)", 1),
    ("licence", "license", r"(this|see) license( file| text| terms)", 1),
    ("licence", "license", r"(see|read) the (accompanying |included |attached )?license", 1),
    ("licence", "licence", r"(see|read) the (accompanying |included |attached )?licence", 1),
    ("licence", "license", r"license (agreement|notice|information|header)", 1),
    ("copyright", "copyright", r"copyright (is|remains|belongs|held by|owner|holder|holders)", 1),
    ("copyright", "copyrighted", r"copyrighted( material| work| by)", 1),
    ("public-domain", "domain", r"(dedicated|released|placed|committed) (in|into|to) the public domain", 3),
    ("public-domain", "domain", r"public domain (work|software|dedication|mark|notice)", 2),
    ("no-warranty", "warranties", r"(disclaims?|excludes?|without) (all |any )?(express |implied )?warranties", 1),
    ("no-warranty", "merchantability", r"merchantability( or| and)? fitness for a particular purpose", 1),
    ("no-warranty", "liable", r"in no event shall the (authors?|copyright holders?)( or copyright holders)? be liable", 2),
    ("as-is", "provided", r"provided as is", 1),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 3),
    ("apache-2.0", "governing", r"see the license for the specific language governing permissions", 3),
    ("bsd", "contributors", r"nor the names of its contributors may be used to endorse", 3),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 3),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies", 3),
    ("mit", "notice", r"the above copyright notice and this permission notice shall be included", 3),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 3),
    ("boost", "machine", r"machine executable object code generated by a source language processor", 3),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3),
    ("wtfpl", "want", r"you just do what the fuck you want to", 3),
    ("beerware", "beer", r"you can buy me a beer in return", 3),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 3),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license", 3),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 3),
    ("mpl-2.0", "subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", 3),
    ("epl-1.0", "accompanies", r"accompanies this distribution and is available at( http)?( www)? eclipse org legal epl", 3),
    ("non-commercial", "noncommercial commercial", r"(for )?non ?commercial (use|purposes) only", 2),
    ("no-derivatives", "derivative derivatives", r"no derivatives?( works)? (allowed|permitted)", 2),
    ("share-alike", "alike sharealike", r"under (the )?share ?alike( terms| licen[cs]e)", 2),
    ("permission-needed", "permission", r"(written|prior|prior written) permission( of| from| is required)", 1),
    ("personal-use", "personal", r"(for )?personal use only", 2),
    ("academic-use", "academic research", r"(for )?(academic|research) (use|purposes) only", 2),
    ("trade-secret", "secret secrets", r"trade secrets?( of| and)", 2),
    ("eula", "eula", r"eula", 2),
    ("eula", "user", r"end user licen[cs]e agreement", 2),
    ("freeware", "freeware", r"freeware( licen[cs]e)?", 2),
    ("shareware", "shareware", r"shareware( licen[cs]e)?", 2),
    ("source-available", "available", r"source available licen[cs]e", 2),
    ("dual-licence", "dual dually", r"(dual|dually) licensed", 2),
    ("patent-grant", "patent", r"patent (grant|license|licence|rights)", 1),
]
#: What may introduce a licence's name, and the priority of the whole.
LEADS = [(r"", 2), (r"licensed under (the )?(terms of (the )?)?", 3), (r"(released|distributed|published|available|covered|provided) under (the )?(terms of (the )?)?", 3), (r"(subject to|governed by|according to|in accordance with) (the )?(terms of (the )?)?", 3)]


def rules() -> list[dict]:
    """Every rule in order: label, keywords, pattern, priority (3 is highest), base."""
    names = list(NAMES)
    for part, long in CC_PARTS.items():
        for version in CC_VERSIONS:
            end, label = (f" {version}" if version else ""), "-".join(["cc", part.replace(" ", "-"), *([version.replace(" ", ".")] if version else [])])
            names.append((label, "cc", f"cc {part}{end}", f"cc {part}{end}"))
            names.append((label, "commons", f"creative commons {long}{f'( international)?{end}' if version else ''}", ""))
    out = [{"label": label, "keywords": phrase.split()[:1], "pattern": phrase, "priority": 0, "base": True} for phrase, label in BASE]
    out += [{"label": label, "keywords": keyword.split(), "pattern": pattern, "priority": priority, "base": False} for label, keyword, pattern, priority in NOTICES]
    for label, keyword, name, identifier in names:
        out += [{"label": label.removesuffix("-short"), "keywords": keyword.split(), "pattern": lead + name, "priority": priority, "base": False} for lead, priority in LEADS]
        if identifier:
            out.append({"label": label.removesuffix("-short"), "keywords": ["identifier"], "pattern": f"spdx license identifier {identifier}", "priority": 3, "base": False})
    return out


#: No rule matches a text that, in lower case, has none of these (and not CC BY with anything between).
PREFILTER = """
licen reserved copyright spdx cc0 gpl commons warrant domain permission redistribution proprietary attribution bsd beer lizenz
nasa syscall cecill copyleft unicode openrail eula freeware shareware merchantability liable misrepresented unencumbered
executable eclipse derivative alike patent contributors advertising sublicense fuck restrictions confidential only secret
""".split()
CC_BY = rf"cc{GAP}by"
#: These stand alone: inside words they are too common.
PREFILTER_WORDS = rf"(?<![a-z0-9])(mpl|provided{GAP}as{GAP}is|open rail)"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


#: The places of the rules that a text's words ask for; each word is looked up among the keywords once.
_HITS = "array_distinct(flatten(transform(array_intersect(words, map_keys(asked)), w -> element_at(asked, w))))"

#: The matches of rule r in norm as word intervals; \\u0001 and \\u0002 can't be in words.
_SPANS = rf"""flatten(transform(transform(hits, i -> rules[i]), r -> aggregate(
  split(regexp_replace(norm, concat('(?<= )', r.pattern, '(?= )'), '\u0001$0\u0002'), '\u0001'),
  named_struct('at', 0, 'spans', cast(array() AS array<struct<first:int,last:int,priority:int,label:string,base:boolean>>)),
  (s, x) -> named_struct('at', s.at + {_spaces("x")}, 'spans', IF(contains(x, '\u0002'), concat(s.spans, array(named_struct(
      'first', s.at - 1, 'last', s.at - 1 + {_spaces("substring_index(x, '\u0002', 1)")}, 'priority', r.priority, 'label', r.label, 'base', r.base))), s.spans)),
  s -> s.spans)))"""

#: Labels that no interval of the same or a higher priority contains; m3, m2, m1: furthest end so far of that priority or higher.
_KEPT = """aggregate(
  array_sort(filter(spans, x -> NOT x.base), (a, b) -> CASE WHEN a.first <> b.first THEN a.first - b.first WHEN a.last <> b.last THEN b.last - a.last
    WHEN a.priority <> b.priority THEN b.priority - a.priority WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END),
  named_struct('m3', -1, 'm2', -1, 'm1', -1, 'labels', cast(array() AS array<string>), 'best', 0),
  (s, x) -> IF(x.last <= CASE x.priority WHEN 3 THEN s.m3 WHEN 2 THEN s.m2 ELSE s.m1 END, s, named_struct(
    'm3', IF(x.priority >= 3, greatest(s.m3, x.last), s.m3), 'm2', IF(x.priority >= 2, greatest(s.m2, x.last), s.m2), 'm1', greatest(s.m1, x.last),
    'labels', array_union(s.labels, array(x.label)), 'best', greatest(s.best, x.priority))))"""


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (of all matches, base ones too), labels and base_labels (sorted arrays), best (priority) of each row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    low, text = F.col("low"), F.col("text")
    some = F.exists(F.array(*map(F.lit, PREFILTER)), lambda t: low.contains(t))
    apart = (low.contains("cc") & low.rlike(CC_BY)) | ((low.contains("mpl") | low.contains("as") | low.contains("rail")) & low.rlike(PREFILTER_WORDS))
    docs = docs.select("doc_id", "text", (some | apart).alias("may"))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1))
    asked: dict[str, list[int]] = {}
    every = rules()
    for i, r in enumerate(every):
        for k in r["keywords"]:
            asked.setdefault(k, []).append(i)
    nothing = "cast(array() AS array<struct<first:int,last:int,priority:int,label:string,base:boolean>>)"
    schema = "array<struct<label:string,keywords:array<string>,pattern:string,priority:int,base:boolean>>"
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("may"), words).alias("words"), F.from_json(F.lit(json.dumps(asked)), "map<string,array<int>>").alias("asked"), F.from_json(F.lit(json.dumps(every)), schema).alias("rules"))
    rows = rows.withColumn("hits", F.coalesce(F.expr(_HITS), F.array().cast("array<int>")))
    norm = F.when(F.size("hits") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    rows = rows.select("doc_id", "n_words", "hits", "rules", norm.alias("norm"))
    found = rows.select("doc_id", "n_words", F.coalesce(F.when(F.size("hits") > 0, F.expr(_SPANS)), F.expr(nothing)).alias("spans"))
    base = F.array_sort(F.array_distinct(F.expr("transform(filter(spans, x -> x.base), x -> x.label)")))
    found = found.withColumn("kept", F.expr(_KEPT)).withColumn("base_labels", base)
    return found.select("doc_id", "n_words", "spans", "base_labels", F.array_sort(F.array_union("base_labels", "kept.labels")).alias("labels"), F.col("kept.best").alias("best"))
