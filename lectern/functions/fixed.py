"""Word lists, patterns and limits that results depend on, stated as they must be."""

#: Whole segments that say nothing, with trailing punctuation allowed.
FILLER_PATTERN = "^(嗯+|啊+|呃+|哦+|唉+|然后呢?|就是|这个|那个|对吧|是吧|好吧|那么|所以说|你知道吗)[，。、！？…\\s]*$"
SENTENCE_ENDS = "。！？”"

#: Decoration that many slides show.
CHROME_WORDS = ["gen0", "gen1", "gen2", "gen3", "gen4", "gen5", "gen6", "结论", "终论", "genol", "genoi"]

#: A page number, its ends told by letters, digits and underscores of any script.
PAGE_NUMBER = "(?<![\\p{L}\\p{N}\\p{M}_])[0-9]{1,3}(?U:\\s)*/(?U:\\s)*[0-9]{1,3}(?![\\p{L}\\p{N}\\p{M}_])"

HAN = "[\\x{4e00}-\\x{9fff}]"
#: Found as soon as four Han characters have been met.
FOUR_HAN = f"(?:{HAN}[^\\x{{4e00}}-\\x{{9fff}}]*+){{4}}"
TITLE_MARK = "(?i)(GEN(?U:\\s)*[0-9]|第(?U:\\s)*[一二三四五六七八九十0-9]+(?U:\\s)*[章代]|^[0-9]{1,2}(?U:\\s)|[·｜|]|规律(?U:\\s)*[0-9]|结论|终论|前瞻|小结|总结)"
TITLE_START = "GEN(?U:\\s)*[0-9]|规律(?U:\\s)*[0-9]|第(?U:\\s)*[一二三四五六七八九十0-9]+(?U:\\s)*[章代]"
JUNK_PREFIX = "(?i)^(?:[&§@#]+|[lI1](?U:\\s)?[0-9]{1,4}[A-Za-z]{0,3}|[0-9]{1,3}|Geno|GENO|EO|OE)(?U:\\s)*"

UI_WORDS = "(另存为|兼容性模式|已保存到|工具箱|页眉|页脚|批注|修订|字数统计|缩放比例|默认版式|邮件合并|目录级别|样式窗格|阅读模式|沉浸式阅读)"
MENU_WORDS = "(文件|开始|插入|引用|邮件|视图|审阅|帮助|格式|窗口|编辑|工具箱|另存为|批注|页眉|页脚)"
FUNCTION_CHARS = "[的了是在和就也都很把被让对与及其这那有为以并而且但]"
URLISH = "(?i)(www\\.|https?://|\\.com|\\.cn|\\.net|\\.org|VPN)"
BRANDS = "(?i)(百度|京东|淘宝|天猫|小红书|知乎|微博|豆瓣|哔哩|bilibili|唯品会|58同城|1688|网易|腾讯|新浪|搜狐|贴吧|抖音|快手|美团|携程|去哪儿|12306)"

#: A line of a description that begins with a time.
TIMED_LINE = "^(?U:\\s)*[(\\[]?((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2})[)\\]]?(?U:\\s)*[-–—:：]?(?U:\\s)*(.+?)(?U:\\s)*$"

#: Names, contents and folders that should not be published.
RISKY_NAME = "(?i)(cookie|credential|secret|tokens?(?![a-z])|password|passwd|\\.env|\\.pem|\\.key$|login data|trust tokens|id_rsa|\\.netrc|\\.npmrc|\\.pypirc|serviceaccount)"
SECRET = (
    "((SESSDATA|bili_jct|DedeUserID|buvid3)\\s*[=:]\\s*[\"']?[A-Za-z0-9%_,\\-]{12,}"
    "|gho_[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{24,}|AKIA[0-9A-Z]{16}"
    "|-----BEGIN [A-Z ]*PRIVATE KEY-----|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z\\-_]{33,})"
)
RISKY_FOLDER = "(?i)(chrome_|chrome_cap|cookies_work|cookies_copy|User Data|node_modules|\\.venv|__pycache__|\\.git$)"
COPYRIGHT_HINT = "(?i)(geekbang|极客时间|付费专栏|专栏导出|课程逐字稿|题库|\\bexam\\b|试卷|内部资料|付费课程)"
CODE_EXTENSIONS = [".py", ".js", ".ts", ".ps1", ".sh", ".bat", ".java", ".go", ".rs", ".c", ".cpp"]
TEXT_EXTENSIONS = [".txt", ".md", ".json", ".py", ".ps1", ".js", ".ts", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".csv", ".html", ".xml", ".env", ".sh", ".bat"]

#: Headings and sentences of a book, in their order in it.
UNTITLED = "未命名"
LANGUAGE = "zh-CN"
ABOUT_HEAD = ["# 关于本书", ""]
NO_FIGURES = "**关于配图**：本片属于口播型视频，全片可用的内容画面只有 %d 个（其余均为软件界面），因此本书不配图。"
CONTENTS_HEAD = ["# 目录与时间轴", "", "| 章 | 标题 | 视频时间 | 字数 |", "|---|---|---|---|"]
CHAPTER_HEAD = "# 第%d章 %s"
TIMED = ["> 视频时间点：", " 起"]
JUMP = "（[跳转原片]("
INTRODUCTION = "【本章导读】"
GLOSSARY_HEAD = ["# 附录A · 术语表", "", "| 术语 | 说明 | 出现位置 |", "|---|---|---|"]
QUOTES_HEAD = ["# 附录B · 金句集", ""]
SOURCE_HEAD = ["# 附录C · 版权与来源说明", ""]
MISSING_IMAGE = "[缺图] "

#: Names of chapters and series.
OPENING = "开篇"
NUMBERED_CHAPTER = "第%d章"
SERIES_TITLE = "合集"
SERIES_SUBTITLE = "%d 集合集 · 共 %d 个分 P · 约 %d 分钟"
CAPTION = "图 %d-%d　%s"
TIMED_CAPTION = "图 %d-%d　视频 %s 处画面"
