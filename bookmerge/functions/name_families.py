"""Given names that stand for each other."""

from __future__ import annotations

# One family a line, in their order; a name in several belongs to the last.
FAMILIES = """
robert bob rob robby bobby bert
william will bill billy liam willy
james jim jimmy jamie jay
john johnny jon jack jacky
charles charlie chuck chaz chas
richard rick rich dick richie ric
thomas tom tommy
michael mike mikey mick mickey micky
david dave davey davie
joseph joe joey
edward ed eddie ned ted teddy
henry harry hal hank
george georgie
samuel sam sammy
daniel dan danny
matthew matt matty
andrew andy drew
christopher chris kit topher
nicholas nick nicky nicolas nic
benjamin ben benny benji
anthony tony ant antonio
stephen steve steven steph
peter pete petey
kenneth ken kenny
donald don donnie
mark marc marcus
paul paulie
timothy tim timmy
joshua josh
gregory greg gregg
patrick pat paddy rick
alexander alex al alec xander sasha
jonathan jon johnathan jonny
raymond ray raye
frank franklin francis fran
lawrence larry laurence lars
ronald ron ronny ronnie
gary garry
gerald jerry gerard ger
harold harry hal
walter walt wally
albert al albie bert
fred freddy frederick alfred freddie
eugene gene
vincent vince vinny vin
jeffrey jeff geoff
arthur art arty
raymond ray
roger rodge
stephen steve
bruce brucey
wayne way
gabriel gabe
jacob jake jakey
ethan eth
nathaniel nathan nate nat
theodore theo ted teddy
reginald reg reggie
leonard len lenny leo
clifford cliff
sebastian seb baz
bartholomew bart
maximilian max maximillian
dominic dom nick
elizabeth liz lizzie beth betty eliza ellie bess bessie libby lisa elspeth
margaret maggie meg peggy peg margie marge rita
katherine kate kathy katie kat katy kathryn catherine cathy cate
jennifer jen jenny
patricia pat patty tricia trish
barbara barb barbie
dorothy dot dottie
helen nell nellie elena
nancy nan
carol carrie caroline carolina carole
mary mae molly polly maria marie
ann anne annie anna ana
susan sue suzie susie suz
linda lindy lin
donna donnie
laura laurie lori
sarah sara sadie sally
jessica jess jessie
amanda mandy
stephanie steph stevie
ashley ash
samantha sam sammy
victoria vicky tori vickie vix
deborah deb debbie
diane di dee
virginia ginny ginger
angela angie angel
melissa missy mel
rebecca becca becky
sandra sandy
theresa terry tess teresa
kristin kris kristine kristen
wendy gwen gwendolyn
rachel rach
emily emma em emmy
natalie nat natalia nathalie
jacqueline jackie jacks
charlotte charlie lottie charley
grace gracie
sophia sophie
eleanor ellie nell nora leonora
abigail abby gail abbey
lillian lily lil lilly
olivia liv livy
cynthia cindy cyndy
constance connie
beverly bev
rosemary rose rosie roz
penelope penny pen
veronica ronnie vera
felicia fee
josephine jo josie
genevieve gen jenny
winifred winnie freddie
harriet hattie harriett
"""
