"""File-type classes: fixed lists of extensions, lower case, compared exactly."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FILE_TYPES = {
    "audio": [
        "aac",
        "ac3",
        "aiff",
        "flac",
        "m4a",
        "mid",
        "midi",
        "mp3",
        "ogg",
        "ra",
        "wav",
        "wma",
    ],
    "doc": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "txt", "rtf", "csv"],
    "exe": ["exe", "com", "bat", "cmd", "msi", "scr", "pif"],
    "pic": ["bmp", "gif", "ico", "jpg", "jpeg", "png", "psd", "svg", "tif", "tiff", "webp"],
    "video": ["avi", "flv", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "wmv"],
    "zip": ["7z", "cab", "bz2", "gz", "rar", "tar", "tgz", "zip"],
}


def file_type(extension: Column) -> Column:
    """Class name of an extension, empty when it is in no list."""
    out = F.lit("")
    for name, extensions in FILE_TYPES.items():
        out = F.when(extension.isin(extensions), F.lit(name)).otherwise(out)
    return out
