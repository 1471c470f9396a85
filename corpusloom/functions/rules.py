"""Rule tables. All of these are fixed values that results depend on."""

#: First matching pattern of a lower-case DOI gives the journal.
JOURNALS = [
    (r"^10\.1103/physrevlett\b", "aps-prl"),
    (r"^10\.1103/physrevb\b", "aps-prb"),
    (r"^10\.1103/physreva\b", "aps-pra"),
    (r"^10\.1103/physreve\b", "aps-pre"),
    (r"^10\.1103/physrevd\b", "aps-prd"),
    (r"^10\.1103/physrevx\b", "aps-prx"),
    (r"^10\.1103/physrevresearch\b", "aps-prresearch"),
    (r"^10\.1103/revmodphys\b", "aps-rmp"),
    (r"^10\.1103/", "aps"),
    (r"^10\.1126/sciadv\b", "science-advances"),
    (r"^10\.1126/", "science"),
    (r"^10\.1038/s41561\b", "nature-geoscience"),
    (r"^10\.1038/s41550\b", "nature-astronomy"),
    (r"^10\.1038/s41586\b", "nature"),
    (r"^10\.1038/ngeo", "nature-geoscience"),
    (r"^10\.1038/", "nature"),
    (r"^10\.1016/j\.icarus\b", "elsevier-icarus"),
    (r"^10\.1016/j\.epsl\b", "elsevier-epsl"),
    (r"^10\.1016/j\.gca\b", "elsevier-gca"),
    (r"^10\.1016/j\.pepi\b", "elsevier-pepi"),
    (r"^10\.1016/j\.chemgeo\b", "elsevier-chemgeo"),
    (r"^10\.1016/", "elsevier"),
    (r"^10\.1029/", "agu"),
    (r"^10\.1073/", "pnas"),
    (r"^10\.1063/", "aip"),
    (r"^10\.1098/", "royal-society"),
    (r"^10\.5194/", "copernicus"),
    (r"^10\.1093/", "oup"),
    (r"^10\.1002/", "wiley"),
    (r"^10\.1146/annurev", "annual-reviews"),
    (r"^10\.3847/", "iop-aas"),
    (r"^10\.1088/", "iop"),
]

#: DOI prefixes that are never an article's.
DOI_BLOCKED = ("10.0/", "10.0000/", "10.5555/")

#: Creative-commons kinds, most specific first, and other licence addresses.
CC_KINDS = ("by-nc-sa", "by-nc-nd", "by-nc", "by-nd", "by-sa", "by")
LICENCE_URLS = [
    (r"creativecommons\.org/publicdomain/zero", "cc0"),
    (r"creativecommons\.org/publicdomain/mark", "public-domain"),
    *[(rf"creativecommons\.org/licenses/{kind}/(\d+\.\d+)", f"cc-{kind}-") for kind in CC_KINDS],
    *[(rf"creativecommons\.org/licenses/{kind}", f"cc-{kind}") for kind in CC_KINDS],
    (r"arxiv\.org/licenses/nonexclusive-distrib", "arxiv-default"),
    (r"arxiv\.org/licenses/assumed-1991-2003", "arxiv-pre-2004"),
    (r"opensource\.org/licenses/mit", "mit"),
    (r"www\.elsevier\.com/.*/tdm", "elsevier-tdm"),
]
LICENCE_SLUG = r"^cc(0|-by|-by-sa|-by-nc|-by-nd|-by-nc-sa|-by-nc-nd)(-\d+\.\d+)?$"
LICENCE_ALIASES = {
    "public-domain": "public-domain",
    "publicdomain": "public-domain",
    "pd": "public-domain",
    "arxiv-default": "arxiv-default",
    "arxiv": "arxiv-default",
    "mit": "mit",
    "pmc-author-manuscript": "pmc-author-manuscript",
    "green-oa-no-license": "green-oa-no-license",
    "osti-public-access": "osti-public-access",
    "public-domain-us": "public-domain-us",
}
#: How freely a licence lets a text be passed on.
TIERS = {
    "true": ("cc0", "public-domain", "public-domain-us", "cc-by", "cc-by-sa", "mit"),
    "restricted": ("cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"),
    "readable": ("arxiv-default", "arxiv-pre-2004", "pmc-author-manuscript", "osti-public-access", "green-oa-no-license"),
}
#: Canonical addresses of licences.
LICENCE_HOMES = {
    "cc0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "public-domain": "https://creativecommons.org/publicdomain/mark/1.0/",
    "cc-by": "https://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa": "https://creativecommons.org/licenses/by-sa/4.0/",
    "cc-by-nc": "https://creativecommons.org/licenses/by-nc/4.0/",
    "cc-by-nd": "https://creativecommons.org/licenses/by-nd/4.0/",
    "cc-by-nc-sa": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "cc-by-nc-nd": "https://creativecommons.org/licenses/by-nc-nd/4.0/",
    "arxiv-default": "https://arxiv.org/licenses/nonexclusive-distrib/1.0/",
    "arxiv-pre-2004": "https://arxiv.org/licenses/assumed-1991-2003/",
    "elsevier-tdm": "https://www.elsevier.com/about/policies/text-and-data-mining",
    "pmc-author-manuscript": "https://pmc.ncbi.nlm.nih.gov/about/copyright/",
    "osti-public-access": "https://www.osti.gov/about/policies",
    "public-domain-us": "https://www.copyright.gov/help/faq/faq-duration.html",
}

#: Data repositories. Name; pattern of a DOI and of an address, group 1 the record; how a
#: record makes a DOI and an address. ``{doi}`` is the whole matched DOI.
REPOSITORIES = [
    ("zenodo", r"(?i)\b10\.5281/zenodo\.(\d+)\b", r"(?i)zenodo\.org/(?:records?|deposit)/(\d+)", "10.5281/zenodo.{id}", "https://zenodo.org/records/{id}"),
    ("dryad", r"(?i)\b10\.5061/dryad\.([a-z0-9]+)(?:[\s.,;)\]<>\"']|$)", r"(?i)datadryad\.org/(?:dataset/|stash/dataset/)?doi:10\.5061/dryad\.([a-z0-9.]+)", "10.5061/dryad.{id}", "https://datadryad.org/dataset/doi:10.5061/dryad.{id}"),
    ("harvard-dataverse", r"\b10\.7910/DVN/([A-Z0-9]+)\b", r"(?i)dataverse\.harvard\.edu/dataset\.xhtml\?persistentId=doi:10\.7910/DVN/([A-Z0-9]+)", "10.7910/DVN/{id}", "https://dataverse.harvard.edu/dataset.xhtml?persistentId=doi:10.7910/DVN/{id}"),
    ("borealis-dataverse", r"\b10\.5683/(SP\d+/[A-Z0-9]+)\b", r"(?i)borealisdata\.ca/dataset\.xhtml\?persistentId=doi:10\.5683/(SP\d+/[A-Z0-9]+)", "10.5683/{id}", "https://borealisdata.ca/dataset.xhtml?persistentId=doi:10.5683/{id}"),
    ("figshare", r"\b10\.6084/m9\.figshare\.(\d+)(?:\.v\d+)?\b", r"(?i)figshare\.com/(?:articles/(?:[^/]+/)*[^/]+/)(\d+)", "10.6084/m9.figshare.{id}", "https://figshare.com/articles/{id}"),
    ("osf", r"\b10\.17605/OSF\.IO/([A-Z0-9]{5,8})\b", r"(?i)osf\.io/([a-z0-9]{5,8})/?", "10.17605/OSF.IO/{id}", "https://osf.io/{id}/"),
    ("pangaea", r"(?i)\b10\.1594/PANGAEA\.(\d+)\b", r"(?i)(?:doi\.)?pangaea\.de/(?:10\.\d+/)?PANGAEA\.(\d+)", "10.1594/PANGAEA.{id}", "https://doi.pangaea.de/10.1594/PANGAEA.{id}"),
    ("ess-dive", r"\b10\.15485/(\d+)\b", r"(?i)data\.ess-dive\.lbl\.gov/view/doi:10\.15485/(\d+)", "10.15485/{id}", "https://data.ess-dive.lbl.gov/view/doi:10.15485/{id}"),
    ("mendeley-data", r"(?i)\b10\.17632/([a-z0-9]+)\.\d+\b", r"(?i)data\.mendeley\.com/datasets/([a-z0-9]+)", "10.17632/{id}", "https://data.mendeley.com/datasets/{id}"),
    ("icpsr", r"\b10\.3886/ICPSR(\d+)(?:\.v\d+)?\b", r"(?i)icpsr\.umich\.edu/web/[^/]+/studies/(\d+)", "10.3886/ICPSR{id}", "https://www.icpsr.umich.edu/web/ICPSR/studies/{id}"),
    ("caltechdata", r"(?i)\b10\.22002/([a-z0-9.\-]+)\b", r"(?i)data\.caltech\.edu/records?/([a-z0-9\-]+)", "10.22002/{id}", "https://data.caltech.edu/records/{id}"),
]
GENERIC_DATAVERSE = r"(?i)([a-z0-9.\-]*(?:dataverse|borealis)[a-z0-9.\-]*/dataset\.xhtml\?persistentId=doi:10\.\d+/[^\s&\"<>')\]]+)"

#: Kinds of extractor failure by the first pattern that the log shows.
FAILURES = [
    (r"CUDA out of memory", "cuda_oom"),
    (r"OutOfMemoryError", "cuda_oom"),
    (r"cudaErrorMemoryAllocation", "cuda_oom"),
    (r"cuMemAlloc.*failed", "cuda_oom"),
    (r"insufficient.*memory", "cuda_oom"),
    (r"FileNotFoundError.*\.(?:pt|pth|onnx|paddle)", "model_load"),
    (r"Failed to download", "model_load"),
    (r"HuggingFace.*not.*found", "model_load"),
    (r"Found no NVIDIA driver", "torch_init"),
    (r"CUDA driver version is insufficient", "torch_init"),
    (r"No space left on device", "disk"),
    (r"PDFSyntaxError", "pdf_parse"),
    (r"is not a valid PDF", "pdf_parse"),
]

#: Publisher stamps that stand where a caption would.
WATERMARKS = [
    r"(?i)\bDownloaded\s+from\b",
    r"(?i)^\s*https?://\S+\s*$",
    r"(?i)\bwww\.[a-z0-9-]+\.(?:com|org)\b",
    r"(?i)\bonlinelibrary\.wiley\.com",
    r"(?i)\bsciencemag\.org\b|\bscience\.org\b",
    r"(?i)\bnature\.com\b",
    r"(?i)©\s*\d{4}",
]
LABELS = r"(?:Fig|Figure|Table|Plate|Scheme|Box)"
CAPTION = rf"(?i){LABELS}\.?\s*[A-Z]?\d+"
NUMBERED_LABEL = r"(?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\."
FIGURE_LABEL = r"(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)"
PANEL = r"(?:(?:\(\s*[a-h]\s*\)|[a-h]\s*\)|[a-h])\s+)?"
FOOTNOTE_OPENER = r"^\s*(?:[*†‡§¶#]|[a-z]\)\s|\(\d+\)\s|\d+\)\s|Notes?\s*[:.])"

#: What a text calls a figure or table.
FIGURE_ID = r"(?:S?\d+|[A-Z]\d+|[A-Z]\.\d+)"
TABLE_ID = r"(?:S?\d+|S?[IVXLC]+|[A-Z]\d+|[A-Z]\.\d+)"
AVAILABILITY = r"(?:data\s+and\s+code|code\s+and\s+data|data|code)\s+(?:availability|accessibility|access|sharing)(?:\s+statement)?"
REFERENCES_HEADING = r"(?im)^#{1,3}\s+(?:references|bibliography|notes|literature\s+cited|references\s+and\s+notes)\b"
