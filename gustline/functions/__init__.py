from gustline.functions import binary, text

__all__ = ["binary", "text"]
