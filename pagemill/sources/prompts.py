"""What the models of the profiles are asked, in this package's own words. ``{width}`` and ``{height}`` are filled in for each page."""

from __future__ import annotations

MARKDOWN = "Write what this page image says as Markdown, in reading order, with its headings, paragraphs, tables and formulas. Add nothing that the page does not hold."

_CELLS = (
    "Find the layout elements of this page image. Answer with one JSON array in reading order; each element is an object with bbox [x1, y1, x2, y2], "
    "category and text. Categories: {categories}. {rules} Keep the page's own words and language."
)
#: The categories that the parsers of these responses know.
DOTS_CATEGORIES = "Caption, Footnote, Formula, List-item, Page-footer, Page-header, Picture, Section-header, Table, Text, Title"
INFINITY_CATEGORIES = "header, title, text, figure, table, formula, figure_caption, table_caption, formula_caption, figure_footnote, table_footnote, page_footnote, footer"
HTML_LABELS = "Caption, Footnote, Equation-Block, List-Group, Page-Header, Page-Footer, Image, Section-Header, Table, Text, Complex-Block, Code-Block, Form, Table-Of-Contents, Figure, Chemical-Block, Diagram, Bibliography, Blank-Page"

DOTS_CELLS = _CELLS.format(categories=DOTS_CATEGORIES, rules="Formulas are LaTeX, tables are HTML, other text is Markdown; pictures have no text.")
INFINITY_CELLS = _CELLS.format(categories=INFINITY_CATEGORIES, rules="Formulas are LaTeX, tables are HTML, other text is Markdown; the text of a figure is empty.")
SVG = 'Draw this image as SVG code with viewBox="0 0 {width} {height}".'
GROUNDED = "Turn this document into Markdown."
BLOCKS = "Read this document block by block."
HTML = f"Write this page image as HTML: one div for each block, in reading order, with data-bbox (x0 y0 x1 y1, from 0 to 1000) and data-label. Labels: {HTML_LABELS}. Put formulas into math elements, describe images in their alt attribute, and leave src empty."

#: By the name of the profile.
OF_MODEL = {
    "zai-org/GLM-OCR": MARKDOWN,
    "rednote-hilab/dots.mocr": DOTS_CELLS,
    "rednote-hilab/dots.mocr-svg": SVG,
    "rednote-hilab/dots.ocr-1.5": DOTS_CELLS,
    "rednote-hilab/dots.ocr-1.5-svg": SVG,
    "rednote-hilab/dots.ocr": DOTS_CELLS,
    "deepseek-ai/DeepSeek-OCR": GROUNDED,
    "baidu/Unlimited-OCR": BLOCKS,
    "FireRedTeam/FireRed-OCR-2B": MARKDOWN,
    "infly/Infinity-Parser2-Pro": INFINITY_CELLS,
    "infly/Infinity-Parser2-Flash": INFINITY_CELLS,
    "datalab-to/chandra-ocr-2": HTML,
}
